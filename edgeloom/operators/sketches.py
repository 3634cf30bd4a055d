"""Projections and sketches of graphs.

A graph's projection is the sum of its chunks' signs, each counted as often as the graph has it; the sketch is which of its components are not negative.
Long forms (gid, i, value) are for reports and joins; arrays and 64-bit words are what is computed with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.operators.hashing import random_vectors, signs
from edgeloom.shipping import ship


def projections(bag: DataFrame, config: Config) -> DataFrame:
    """gid, i, p. Signs are worked out a batch at a time and summed per graph before anything is shuffled: a task sends one vector a graph, never a vector a chunk."""
    seed, bits, length = config.seed, config.sketch_bits, config.chunk_length
    ship(bag.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["gid", "p"])
            sums.clear()
            return out

        for batch in batches:
            gids, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            words = batch.column(1).dictionary_encode()
            known = words.dictionary.to_pylist()
            order = np.argsort(gids, kind="stable")
            cuts = np.flatnonzero(np.diff(gids[order])) + 1
            # chunks by bits in blocks of components, each worked out once, so that a batch of any width stays small
            for at in range(0, bits, 256):
                mine = signs(known, seed, bits, length, slice(at, at + 256)).astype(np.float32)[words.indices.to_numpy()]
                for rows in np.split(order, cuts):
                    if len(rows):
                        vector = sums.setdefault(int(gids[rows[0]]), np.zeros(bits, np.int64))
                        vector[at : at + 256] += np.rint(counts[rows] @ mine[rows]).astype(np.int64)
            if len(sums) > 2000:
                yield flush()
        if sums:
            yield flush()

    partial = bag.select(F.col("gid").cast("int"), "chunk", F.col("cnt").cast("long")).mapInArrow(run, "gid int, p array<bigint>")
    return partial.select("gid", F.posexplode("p").alias("i", "p")).groupBy("gid", "i").agg(F.sum("p").alias("p"))


def projections_by_join(bag: DataFrame, chunk_signs: DataFrame) -> DataFrame:
    """The same from a table of signs, with joins alone."""
    return bag.join(chunk_signs, "chunk").groupBy("gid", "i").agg(F.sum(F.col("cnt") * F.col("sign")).alias("p"))


def bit_of(p: Column) -> Column:
    return F.when(p >= 0, 1).otherwise(0)


def sketch_bits(projected: DataFrame) -> DataFrame:
    """gid, i, bit."""
    return projected.select("gid", "i", bit_of(F.col("p")).alias("bit"))


def sketch_words(projected: DataFrame, key: str = "gid") -> DataFrame:
    """key, words: the sketch as 64-bit words, component 64 w + b in bit b of word w."""
    bit = F.when(F.col("p") >= 0, F.expr("shiftleft(1L, cast(i % 64 as int))")).otherwise(F.lit(0))
    words = projected.groupBy(key, F.expr("i div 64").alias("w")).agg(F.bit_or(bit).alias("word"))
    return words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x["word"]).alias("words"))


def simhash_projections(vectors: DataFrame, vocab: DataFrame, config: Config) -> DataFrame:
    """gid, i, p over random vectors instead of hashes."""
    return vectors.join(random_vectors(vocab, config), "chunk_id").groupBy("gid", "i").agg(F.sum(F.col("cnt") * F.col("r")).alias("p"))
