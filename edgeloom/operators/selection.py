"""Which graphs and edges take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.config import Config


def scenario(gid: Column | str = "gid") -> Column:
    return F.floor((F.col(gid) if isinstance(gid, str) else gid) / 100).cast("int")


def in_scenarios(scenarios: tuple[int, ...], gid: str = "gid") -> Column:
    """Ranges of gid, which reach a Parquet scan, where gid div 100 would not."""
    out, wanted = None, sorted(set(scenarios))
    at = 0
    while at < len(wanted):
        end = at
        while end + 1 < len(wanted) and wanted[end + 1] == wanted[end] + 1:
            end += 1
        one = F.col(gid).between(wanted[at] * 100, wanted[end] * 100 + 99)
        out = one if out is None else out | one
        at = end + 1
    return F.lit(False) if out is None else out


def of_dataset(edges: DataFrame, config: Config) -> DataFrame:
    return edges.filter(in_scenarios(config.scenarios))


def train_edges(edges: DataFrame, bootstrap: DataFrame) -> DataFrame:
    return edges.join(bootstrap.select("gid").distinct(), "gid", "left_semi")


def test_edges(edges: DataFrame, bootstrap: DataFrame) -> DataFrame:
    return edges.join(bootstrap.select("gid").distinct(), "gid", "left_anti")


def test_gids(edges: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """Graphs that are streamed: those with edges that no cluster starts with."""
    return test_edges(edges, bootstrap).select("gid").distinct()


def counters(edges: DataFrame, bootstrap: DataFrame, config: Config) -> DataFrame:
    """One row: graphs (largest gid + 1, over all edges), and train, test and dropped edges."""
    known = bootstrap.select("gid").distinct().withColumn("trains", F.lit(True))
    held = edges.groupBy("gid").count().join(known, "gid", "left").withColumn("kept", in_scenarios(config.scenarios))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("long")
    trains = F.coalesce("trains", F.lit(False))
    return held.agg((F.max("gid") + 1).cast("long").alias("num_graphs"), count(F.col("kept") & trains).alias("train_edges"), count(F.col("kept") & ~trains).alias("test_edges"), count(~F.col("kept")).alias("dropped_edges"))


def attack_labels(edges: DataFrame) -> DataFrame:
    """gid, label: of 600 graphs (largest gid + 1, over all edges) 300 to 399 are attacks, else the upper half; no rows without edges."""
    graphs = F.broadcast(edges.agg((F.max("gid") + 1).alias("_graphs")))
    attack = F.when(F.col("_graphs") == 600, F.col("gid").between(300, 399)).otherwise(F.col("gid") >= F.floor(F.col("_graphs") / 2))
    return edges.select("gid").distinct().join(graphs).select("gid", F.when(attack, "attack").otherwise("normal").alias("label"))
