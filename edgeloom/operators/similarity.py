"""Similarities of graphs, exact and by sketch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.config import PI


def sketch_similarity(a: Column, b: Column, bits: int) -> Column:
    """The share of components in which two sketches (64-bit words) agree."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return 1 - differ / F.lit(float(bits))


def cosine_of_sketch(similarity: Column) -> Column:
    return F.cos(F.lit(PI) * (1 - similarity))


def distance_of_sketch(similarity: Column) -> Column:
    """0 for equal sketches to 2 for opposite ones."""
    return 1 - cosine_of_sketch(similarity)


def angular(cosine: Column) -> Column:
    """1 - angle / pi; the cosine is held within 1, which rounding may pass."""
    return 1 - F.acos(F.least(F.lit(1.0), cosine)) / F.lit(PI)


def cosines(vectors: DataFrame) -> DataFrame:
    """gid_a, gid_b, cosine of the ordered pairs that share a chunk, each graph with itself too; all other pairs have 0. Joined on the chunk, so graphs without a common chunk never meet."""
    norm = vectors.groupBy("gid").agg(F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt"))).alias("norm"))
    a = vectors.select(F.col("gid").alias("gid_a"), "chunk_id", F.col("cnt").alias("x"))
    b = vectors.select(F.col("gid").alias("gid_b"), "chunk_id", F.col("cnt").alias("y"))
    dots = a.join(b, "chunk_id").groupBy("gid_a", "gid_b").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))
    na, nb = norm.select(F.col("gid").alias("gid_a"), F.col("norm").alias("na")), norm.select(F.col("gid").alias("gid_b"), F.col("norm").alias("nb"))
    return dots.join(na, "gid_a").join(nb, "gid_b").select("gid_a", "gid_b", F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def all_pairs(graphs: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Every ordered pair of graphs, as the report is defined: its rows are the square of the graphs, so it is for a chosen set of them."""
    a = graphs.select(*(F.col(c).alias(f"{c}_a") for c in graphs.columns))
    b = (other or graphs).select(*(F.col(c).alias(f"{c}_b") for c in graphs.columns))
    return a.crossJoin(b)


def similarity_report(vectors: DataFrame, stream_words: DataFrame, random_words: DataFrame, bits: int) -> DataFrame:
    """gid_a, gid_b, cosine, angular, simhash, simhash_cosine, stream, stream_cosine, error (stream less angular) of every ordered pair."""
    both = stream_words.select("gid", F.col("words").alias("stream")).join(random_words.select("gid", F.col("words").alias("random")), "gid")
    pairs = all_pairs(both).join(cosines(vectors), ["gid_a", "gid_b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    pairs = pairs.withColumn("angular", angular(F.col("cosine"))).withColumn("simhash", sketch_similarity(F.col("random_a"), F.col("random_b"), bits)).withColumn("stream", sketch_similarity(F.col("stream_a"), F.col("stream_b"), bits))
    return pairs.select("gid_a", "gid_b", "cosine", "angular", "simhash", cosine_of_sketch(F.col("simhash")).alias("simhash_cosine"), "stream", cosine_of_sketch(F.col("stream")).alias("stream_cosine"), (F.col("stream") - F.col("angular")).alias("error"))
