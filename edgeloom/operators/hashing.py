"""The hash family that maps chunks to signs.

h_i(s) is the top bit of m[i][0] + sum of m[i][j+1] * byte j, modulo 2^64, as -1 or 1. The multipliers are two 32-bit halves of an MD5 over seed, i
and j. As columns these are kept as halves, as a 64-bit word would overflow; NumPy works on whole words.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.shipping import ship

#: Chunks whose signs are worked out at once.
SIGNS = 1024


def hash_family(spark: SparkSession, config: Config) -> DataFrame:
    """i, j, hi, lo; j = 0 is the term that is added."""
    width = config.chunk_length + 1
    key = F.md5(F.concat_ws(":", F.lit(str(config.seed)), F.col("i").cast("string"), F.col("j").cast("string")).cast("binary"))
    half = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast("long")
    rows = spark.range(config.sketch_bits * width).select(F.expr(f"id div {width}").cast("int").alias("i"), (F.col("id") % width).cast("int").alias("j"))
    return rows.select("i", "j", half(1).alias("hi"), half(9).alias("lo"))


def chunk_signs(chunks: DataFrame, config: Config) -> DataFrame:
    """chunk, i, sign for each distinct chunk. Signs are worked out as an array per chunk and spread last, so nothing but the result has a row per component."""
    seed, bits, length = config.seed, config.sketch_bits, config.chunk_length
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNS):
                part = batch.column(0).slice(at, SIGNS)
                found = signs(part.to_pylist(), seed, bits, length)
                flat = pa.array(found.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bits), flat)], names=["chunk", "signs"])

    spelled = chunks.select("chunk").distinct().mapInArrow(run, "chunk string, signs array<int>")
    return spelled.select("chunk", F.posexplode("signs").alias("i", "sign"))


@functools.lru_cache(maxsize=4)
def family_words(seed: int, bits: int, chunk_length: int) -> np.ndarray:
    """The same family as 64-bit words: bits by 1 + chunk_length."""
    words = [int.from_bytes(hashlib.md5(f"{seed}:{i}:{j}".encode()).digest()[:8], "big") for i in range(bits) for j in range(chunk_length + 1)]
    return np.array(words, np.uint64).reshape(bits, chunk_length + 1)


def signs(chunks: list[str], seed: int, bits: int, chunk_length: int, part: slice = slice(None)) -> np.ndarray:
    """Chunks by bits, or by a part of them, -1 or 1. A character counts as its code point."""
    family = family_words(seed, bits, chunk_length)[part]
    spelled = np.zeros((len(chunks), chunk_length), np.uint64)
    for row, chunk in enumerate(chunks):
        raw = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        spelled[row, : len(raw)] = raw
    total = np.broadcast_to(family[:, 0], (len(chunks), len(family))).copy()
    for j in range(chunk_length):
        total += spelled[:, j, None] * family[None, :, j + 1]
    return np.where(total >> np.uint64(63), 1, -1).astype(np.int8)


def random_vectors(vocab: DataFrame, config: Config) -> DataFrame:
    """i, chunk_id, r: signs for random projections over the vocabulary, by MD5 over seed, i and id."""
    key = F.md5(F.concat_ws(":", F.lit(f"r{config.seed}"), F.col("i").cast("string"), F.col("chunk_id").cast("string")).cast("binary"))
    rows = vocab.select("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(config.sketch_bits - 1))).alias("i"))
    return rows.select("i", "chunk_id", F.when(F.substring(key, 1, 1) >= "8", 1).otherwise(-1).alias("r"))
