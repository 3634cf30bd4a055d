"""Bootstrap clusters: centroids, and the distance of every graph to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators.similarity import distance_of_sketch, sketch_similarity
from edgeloom.operators.sketches import bit_of, sketch_words


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"))


def centroids(projected: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """cluster_id, i, c: the mean projection of a cluster's listed graphs; one without edges counts as zero."""
    sums = members.join(projected, "gid").groupBy("cluster_id", "i").agg(F.sum("p").alias("total"))
    every = cluster_sizes(members).select("cluster_id", "size", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("i"))
    return every.join(sums, ["cluster_id", "i"], "left").select("cluster_id", "i", (F.coalesce("total", F.lit(0)) / F.col("size").cast("double")).alias("c"))


def centroid_bits(centers: DataFrame) -> DataFrame:
    return centers.select("cluster_id", "i", bit_of(F.col("c")).alias("bit"))


def centroid_words(centers: DataFrame) -> DataFrame:
    """cluster_id, center: the sketch of a centroid as 64-bit words."""
    return sketch_words(centers.withColumnRenamed("c", "p"), "cluster_id").withColumnRenamed("words", "center")


#: Bytes of centroid sketches that are sent to every task, and centroids in a block beyond that.
BROADCAST, BLOCK = 64 << 20, 4096


def distances(words: DataFrame, centers: DataFrame, bits: int, limit: int = BROADCAST) -> DataFrame:
    """gid, cluster_id, distance of every graph to every centroid. Centroids are put into blocks, a row each; graphs meet all blocks by their numbers, which is one
    broadcast of a checked size where the centroids take `limit` bytes at most, else a shuffle in which a graph has a row per block."""
    n = centers.count()
    blocks = max(1, -(-n // BLOCK))
    rows = centers.groupBy(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("cluster_id", "center")).alias("centers"))
    if n * (bits // 8 + 32) <= limit:
        rows = F.broadcast(rows)
    met = words.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(rows, "block").select("gid", "words", F.explode("centers").alias("c"))
    return met.select("gid", "c.cluster_id", distance_of_sketch(sketch_similarity(F.col("words"), F.col("c.center"), bits)).alias("distance"))


def train_scores(words: DataFrame, members: DataFrame, centers: DataFrame, bits: int) -> DataFrame:
    """gid, cluster_id, score: the distance of each listed graph to its own centroid. A graph without edges has a zero projection, whose sketch is all ones."""
    held = members.join(words, "gid", "left").join(centers, "cluster_id")
    ones = F.transform("center", lambda _: F.lit(-1).cast("long"))
    whole = bits % 64 == 0
    blank = ones if whole else F.concat(F.slice(ones, 1, bits // 64), F.array(F.lit((1 << bits % 64) - 1).cast("long")))
    return held.select("gid", "cluster_id", distance_of_sketch(sketch_similarity(F.coalesce("words", blank), F.col("center"), bits)).alias("score"))


def nearest(measured: DataFrame) -> DataFrame:
    """gid, cluster_id, distance of the nearest centroid; ties go to the lowest id."""
    best = F.min(F.struct("distance", "cluster_id")).alias("best")
    return measured.groupBy("gid").agg(best).select("gid", "best.cluster_id", "best.distance")


def is_anomaly(distance: Column, threshold: Column, global_threshold: float) -> Column:
    return distance > F.least(F.lit(float(global_threshold)), threshold)


def anomaly_flags(found: DataFrame, thresholds: DataFrame, global_threshold: float) -> DataFrame:
    """gid, cluster_id, distance, anomaly."""
    return found.join(thresholds, "cluster_id").select("gid", "cluster_id", "distance", is_anomaly(F.col("distance"), F.col("threshold"), global_threshold).alias("anomaly"))


def ranked(measured: DataFrame) -> DataFrame:
    """gid, cluster_id, distance, rank of all centroids for each graph, nearest first."""
    return measured.withColumn("rank", F.row_number().over(W.partitionBy("gid").orderBy("distance", "cluster_id")))
