"""Periodic snapshots of the clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.config import UNSEEN


def snapshots(states: DataFrame, scores: DataFrame, gids: DataFrame, interval: int) -> DataFrame:
    """interval, gid, cluster_id, score.

    states: seq (dense), gid, cluster_id, score after each edge; scores: the same of listed graphs before the stream; gids: the streamed graphs. Of M
    edges there are ceil(M / interval) snapshots: number i after edge interval * i, the last after the last edge. Graphs not seen yet have cluster and score UNSEEN.
    """
    last = states.agg(F.max("seq").alias("last"))
    n = F.floor((F.col("last") + F.lit(interval)) / F.lit(float(interval))).cast("int")
    # the first snapshot that shows an edge; all after the last full boundary are shown by the last one
    first = F.least(F.ceil(F.col("seq") / F.lit(float(interval))).cast("int"), n - 1)
    shown = states.join(F.broadcast(last)).select(first.alias("interval"), "gid", F.struct("seq", "cluster_id", "score").alias("state"))
    shown = shown.groupBy("interval", "gid").agg(F.max("state").alias("state"))
    grid = F.broadcast(last).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("interval"))
    known = gids.select("gid").join(scores.select("gid").withColumn("listed", F.lit(True)), "gid", "left_anti").select("gid", F.lit(UNSEEN).alias("c0"), F.lit(float(UNSEEN)).alias("s0"))
    known = known.unionByName(scores.select("gid", F.col("cluster_id").alias("c0"), F.col("score").alias("s0")))
    every = known.join(grid).join(shown, ["interval", "gid"], "left")
    carried = F.last("state", ignorenulls=True).over(W.partitionBy("gid").orderBy("interval").rowsBetween(W.unboundedPreceding, 0))
    return every.withColumn("seen", carried).select("interval", "gid", F.coalesce("seen.cluster_id", "c0").cast("int").alias("cluster_id"), F.coalesce("seen.score", "s0").alias("score"))
