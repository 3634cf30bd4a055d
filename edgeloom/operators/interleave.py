"""Orders in which the edges of many graphs may arrive."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators.ordering import rank_within
from edgeloom.shipping import ship


def stream_groups(gids: DataFrame, parallel: int, seed: int = 23) -> DataFrame:
    """gid, place, group: graphs in an order drawn by MD5 over seed and gid, `parallel` of them to a group."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("gid").cast("string")).cast("binary"))
    # ranked within parts of the keys' range, of which only the counts meet in one task
    keyed = gids.select("gid").distinct().withColumn("key", key).withColumn("head", F.substring("key", 1, 3))
    before = keyed.groupBy("head").count().select("head", (F.sum("count").over(W.orderBy("head")) - F.col("count")).alias("before"))
    placed = keyed.withColumn("r", F.row_number().over(W.partitionBy("head").orderBy("key", "gid"))).join(before, "head").withColumn("place", F.col("before") + F.col("r") - 1)
    return placed.select("gid", "place", F.expr(f"cast(place div {parallel} as int)").alias("group"))


def interleave(edges: DataFrame, parallel: int, seed: int = 23) -> DataFrame:
    """edges with a new dense seq: groups one after another; within a group, again and again the next edge of a graph drawn among those that have one left.

    The draws need the graphs' edge counts alone; each group is drawn by itself, in batches, from a seed of its own. Edges then join their draw by graph and rank.
    """
    counts = edges.groupBy("gid").count()
    groups = stream_groups(counts, parallel, seed).join(counts, "gid")
    totals = groups.groupBy("group").agg(F.sum("count").alias("n"))
    first = totals.select("group", (F.sum("n").over(W.orderBy("group")) - F.col("n")).alias("first"))
    plan = groups.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "gid", "count"))).alias("graphs")).join(first, "group")
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, graphs, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for gids, ranks, seqs in draws([(g["gid"], g["count"]) for g in graphs], random.Random(f"{seed}:{group}"), at):
                    yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int32()), pa.array(ranks, pa.int64()), pa.array(seqs, pa.int64())], names=["gid", "k", "place"])

    drawn = plan.select("group", "graphs", F.col("first").cast("long")).mapInArrow(run, "gid int, k long, place long")
    ranked = rank_within(edges, ["gid"])
    return ranked.join(drawn, ["gid", "k"]).withColumn("seq", F.col("place")).select(*edges.columns)


def draws(graphs: list[tuple[int, int]], rng: random.Random, at: int, size: int = 10_000) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Batches of gid, rank and place."""
    left = [[gid, 0, count] for gid, count in graphs if count > 0]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    while left:
        k = rng.randrange(len(left))
        graph = left[k]
        for column, value in zip(out, (graph[0], graph[1], at), strict=True):
            column.append(value)
        graph[1] += 1
        at += 1
        if graph[1] == graph[2]:
            left.pop(k)
        if len(out[0]) == size:
            yield out
            out = ([], [], [])
    if out[0]:
        yield out
