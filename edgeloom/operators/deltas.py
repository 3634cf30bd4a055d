"""What each streamed edge changes: the chunks that come and go, and projections as running sums.

At most max_edges edges are live over all graphs. The stream's seq is dense, so the live edges of a source node after an edge of it are those of its
edges within the last max_edges of seq: a window frame, not a cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.operators.hashing import chunk_signs
from edgeloom.operators.ordering import BLOCK, rank_within, with_context
from edgeloom.operators.shingles import NODE

#: Edges of a node that are worked off at once.
RANKS = 1 << 16


def live_counts(edges: DataFrame, max_edges: int | None) -> DataFrame:
    """Edges with n, the live out-edges of their source after them. A hot node's edges are counted by blocks of seq, with the edges before that are still live."""
    if max_edges is None:
        return rank_within(edges, NODE).withColumn("n", F.col("k") + 1).drop("k")
    held = with_context(edges, "seq", BLOCK, max_edges - 1)
    live = W.partitionBy(*NODE, "_block").orderBy("seq").rangeBetween(-(max_edges - 1), 0)
    return held.withColumn("n", F.count("*").over(live)).filter("_own").drop("_block", "_own")


def chunk_deltas(edges: DataFrame, config: Config) -> DataFrame:
    """What deltas_of gives, for every edge of a dense stream."""
    return deltas_of(live_counts(edges, config.max_edges), config)


def deltas_of(counted: DataFrame, config: Config) -> DataFrame:
    """seq, gid, n, in_chunk, out_chunk, full_chunk for every edge, which has n (live_counts).

    in_chunk is the last chunk of the source's shingle after the edge, out_chunk what it replaces (null if nothing). Only the last chunk_length + 2 edges
    are gathered, which spell the last two chunks. full_chunk is null in the reference mode; in the consistent mode it is the chunk
    that the edge has filled while beginning another, which happens at odd lengths alone.
    """
    c = config.chunk_length
    held = c + 2
    # a hot node's edges are worked off by blocks of their rank, with the last ones before
    ranked = with_context(rank_within(counted, NODE), "k", RANKS, held - 1)
    recent = W.partitionBy(*NODE, "_block").orderBy("k").rowsBetween(-(held - 1), 0)
    rows = ranked.withColumn("recent", F.collect_list(F.concat("e_type", "dst_type")).over(recent)).filter("_own")
    mine = F.slice("recent", -F.least(F.col("n"), F.size("recent").cast("long")).cast("int"), F.least(F.col("n"), F.lit(held)).cast("int"))
    tail = F.concat(F.when(F.col("n") <= held, F.concat(F.lit(" "), "src_type")).otherwise(F.lit("")), F.array_join(mine, ""))
    rows = rows.withColumn("tail", tail).withColumn("last", ((2 * F.col("n") + 1) % c + 1).cast("int"))
    size, last = F.length("tail"), F.col("last")
    rows = rows.withColumn("in_chunk", F.substr("tail", size - last + 1, last))
    before = F.substr("tail", size - last - c + 1, F.lit(c))
    out = F.when(F.col("n") == 1, None).when(last == 1, F.substr("tail", size - c, F.lit(c - 1))).when(last == 2, None).otherwise(F.substr("tail", size - last + 1, last - 2))
    full = F.when((F.col("n") > 1) & (last == 1), before) if config.odd_chunk_mode == "consistent" else F.lit(None).cast("string")
    return rows.select("seq", "gid", "n", "in_chunk", out.alias("out_chunk"), full.alias("full_chunk"))


def signed_chunks(deltas: DataFrame) -> DataFrame:
    """seq, gid, chunk, s: 1 for each chunk that comes and -1 for each that goes."""
    one = lambda name, s: F.struct(F.col(name).alias("chunk"), F.lit(s).alias("s"))
    return deltas.select("seq", "gid", F.explode(F.array(one("in_chunk", 1), one("full_chunk", 1), one("out_chunk", -1))).alias("x")).select("seq", "gid", "x.chunk", "x.s").filter("chunk is not null")


def running_projections(deltas: DataFrame, config: Config) -> DataFrame:
    """seq, gid, i, delta, p: each graph's projection after each of its edges. For chosen graphs: it has a row per edge and component."""
    marked = signed_chunks(deltas)
    signed = marked.join(chunk_signs(marked.select("chunk"), config), "chunk")
    per = signed.groupBy("seq", "gid", "i").agg(F.sum(F.col("s") * F.col("sign")).alias("delta"))
    return per.withColumn("p", F.sum("delta").over(W.partitionBy("gid", "i").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def final_projections(deltas: DataFrame, config: Config) -> DataFrame:
    """gid, i, p after the whole stream. The order of a sum does not matter, so chunks are counted before they meet their signs."""
    from edgeloom.operators.sketches import projections

    return projections(signed_chunks(deltas).groupBy("gid", "chunk").agg(F.sum("s").alias("cnt")).filter("cnt <> 0"), config)
