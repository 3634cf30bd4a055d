"""Edges and bootstrap clusters from files and tables, and edges back to files.

An edge is src_id, src_type, dst_id, dst_type, e_type, gid and seq, its place in the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.files import write_file

EDGE_FILE = "src_id long, src_type string, dst_id long, dst_type string, e_type string, gid int"
COLUMNS = ("seq", "src_id", "src_type", "dst_id", "dst_type", "e_type", "gid")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A file of tab-separated edges in order of arrival, or a folder of such files in the order of their names. A row's place is its file, the start of its split, and its
    row of that split: the splits alone are put in order, and rows are ranked within theirs."""
    rows = spark.read.csv(path, sep="\t", schema=EDGE_FILE, mode="FAILFAST", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    counts = placed.groupBy("_file", "_start").count()
    before = counts.select("_file", "_start", (F.sum("count").over(W.orderBy("_file", "_start")) - F.col("count")).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_file", "_start").orderBy("_row")))
    return ranked.join(before, ["_file", "_start"]).withColumn("seq", (F.col("_before") + F.col("_rank") - 1).cast("long")).select(*COLUMNS)


def write_edges(edges: DataFrame, path: str, parts: int | None = None) -> None:
    """Tab-separated parts, each sorted by seq and together in its order; as many as Spark finds fit, or `parts`."""
    rows = (edges.repartitionByRange(parts, "seq") if parts else edges.repartitionByRange("seq")).sortWithinPartitions("seq")
    rows.select("src_id", "src_type", "dst_id", "dst_type", "e_type", "gid").write.csv(path, sep="\t", quote="")


def write_bootstrap(members: DataFrame, thresholds: DataFrame, global_threshold: float, path: str) -> None:
    """The file that read_bootstrap reads. Clusters and their listed graphs are the parameters of a run and few."""
    listed: dict[int, list[int]] = {}
    for r in members.orderBy("cluster_id", "gid").collect():
        listed.setdefault(r["cluster_id"], []).append(r["gid"])
    limits = {r["cluster_id"]: r["threshold"] for r in thresholds.collect()}
    if sorted(limits) != list(range(len(limits))):
        raise ValueError("cluster ids are 0, 1, 2, ...")
    lines = [f"{len(limits)} {global_threshold}", *(" ".join(map(str, (limits[k], *listed.get(k, [])))) for k in sorted(limits))]
    write_file(path, "".join(f"{x}\n" for x in lines).encode())


def read_bootstrap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float]:
    """(cluster_id, gid), (cluster_id, threshold) and the global threshold. The file's first line is `clusters threshold`, each further one `threshold gid gid ...`; it is small and read whole."""
    lines = [r[0].split() for r in spark.read.text(path, wholetext=False).coalesce(1).collect()]
    n, threshold = int(lines[0][0]), float(lines[0][1])
    clusters = lines[1 : n + 1]
    if len(clusters) < n:
        raise ValueError(f"{n} clusters are announced, {len(clusters)} follow")
    members = [(i, int(g)) for i, line in enumerate(clusters) for g in line[1:]]
    return (
        spark.createDataFrame(members, "cluster_id int, gid int"),
        spark.createDataFrame([(i, float(line[0])) for i, line in enumerate(clusters)], "cluster_id int, threshold double"),
        threshold,
    )


def checked_bootstrap(members: DataFrame, clusters: DataFrame, allow_duplicates: bool = False) -> DataFrame:
    """members, if every cluster has a graph and, unless allowed, no graph is in two clusters."""
    if not clusters.join(members, "cluster_id", "left_anti").isEmpty():
        raise ValueError("a bootstrap cluster has no graph")
    if not allow_duplicates and not members.groupBy("gid").count().filter("count > 1").isEmpty():
        raise ValueError("a graph is in two bootstrap clusters")
    return members


def edges_of_events(events: DataFrame) -> DataFrame:
    """Edges over the events table: event_id is dense and sets seq."""
    k = F.get_json_object("props", "$.k").cast("long")
    whole = F.floor("value").cast("long")
    return events.select(
        F.col("event_id").cast("long").alias("seq"),
        (whole % 3).alias("src_id"),
        F.substring("event_type", 1, 1).alias("src_type"),
        (100 + k % 50).alias("dst_id"),
        F.char(97 + k % 4).alias("dst_type"),
        F.char(113 + whole % 5).alias("e_type"),
        ((F.col("user_id") % 60) * 10).cast("int").alias("gid"),
    )


def bootstrap_of_edges(edges: DataFrame) -> DataFrame:
    """(cluster_id, gid) of the demonstration: graphs whose gid is a multiple of 20, in two clusters by scenario."""
    return edges.filter("gid % 20 = 0").select(F.expr("cast((gid div 100) % 2 as int)").alias("cluster_id"), "gid").distinct()
