"""Locality-sensitive banding of sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.operators.components import components


def bands(bits: DataFrame, config: Config) -> DataFrame:
    """gid, band, bucket: band b is components b * rows to b * rows + rows - 1, the lowest first."""
    rows = config.band_rows
    value = F.sum(F.col("bit").cast("long") * F.expr(f"shiftleft(1L, cast(i % {rows} as int))")).alias("bucket")
    return bits.groupBy("gid", F.expr(f"cast(i div {rows} as int)").alias("band")).agg(value)


def labelled(banded: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The bands of the graphs that labels (gid, label) gives this label; a graph without a label is left out."""
    return banded.join(labels.filter(F.col("label") == label).select("gid").distinct(), "gid", "left_semi")


def neighbors(banded: DataFrame) -> DataFrame:
    """gid_a, gid_b: graphs that share a bucket, each with itself too. By definition it has all pairs of a bucket; lsh_components and isolated do without them."""
    a = banded.select("band", "bucket", F.col("gid").alias("gid_a"))
    b = banded.select("band", "bucket", F.col("gid").alias("gid_b"))
    return a.join(b, ["band", "bucket"]).select("gid_a", "gid_b").distinct()


def lsh_components(banded: DataFrame) -> DataFrame:
    """gid, component: the smallest gid reachable over shared buckets. A bucket is a star around its smallest gid, so links grow with the buckets' members, not with their pairs."""
    hubs = banded.groupBy("band", "bucket").agg(F.min("gid").alias("hub"))
    links = banded.join(hubs, ["band", "bucket"]).select(F.col("hub").alias("a"), F.col("gid").alias("b")).filter("a <> b").distinct()
    nodes = banded.select("gid").distinct().select(F.col("gid").alias("node"), F.col("gid").alias("label"))
    return components(nodes, links).select(F.col("node").alias("gid"), F.col("label").alias("component"))


def isolated(banded: DataFrame, inserted: DataFrame) -> DataFrame:
    """gid, isolated: whether no bucket of a graph holds an inserted one. An inserted graph finds itself."""
    held = inserted.select("band", "bucket").distinct().withColumn("hit", F.lit(True))
    found = banded.join(held, ["band", "bucket"], "left").groupBy("gid").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    return found.select("gid", (~F.col("hit")).alias("isolated"))
