"""Adjacency, shingles and chunk bags.

A source node's shingle is a space, its type, and the edge and destination types of its out-edges in order of arrival. A graph is the
bag of the chunks that its shingles are cut into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators.ordering import rank_within

NODE = ["gid", "src_id", "src_type"]


def adjacency(edges: DataFrame) -> DataFrame:
    """gid, src_id, src_type, edges (by seq): whole lists, for reports. Chunks do not need them: see chunk_bag."""
    return edges.groupBy(*NODE).agg(F.array_sort(F.collect_list(F.struct("seq", "dst_id", "dst_type", "e_type"))).alias("edges"))


def shingle_of(src_type: Column, edges: Column) -> Column:
    return F.concat(F.lit(" "), src_type, F.array_join(F.transform(edges, lambda e: F.concat(e["e_type"], e["dst_type"])), ""))


def node_shingles(edges: DataFrame) -> DataFrame:
    return adjacency(edges).select(*NODE, shingle_of(F.col("src_type"), F.col("edges")).alias("shingle"))


def chunks_of(text: Column, length: int) -> Column:
    """Fixed-length chunks; the last may be short."""
    return F.transform(F.sequence(F.lit(1), F.length(text), F.lit(length)), lambda at: F.substr(text, at, F.lit(length)))


def node_chunks(edges: DataFrame, length: int) -> DataFrame:
    """gid, src_id, src_type, chunk_no, chunk: the chunks of every shingle, without ever holding a node's whole list. An edge's rank among the node's says which chunk its characters are in, so a group holds one chunk."""
    ranked = rank_within(edges, NODE)
    text = F.when(F.col("k") == 0, F.concat(F.lit(" "), "src_type", "e_type", "dst_type")).otherwise(F.concat("e_type", "dst_type"))
    first = F.when(F.col("k") == 0, F.lit(0)).otherwise(2 * F.col("k") + 2)
    if length % 2 == 0:  # an edge's two characters are in one chunk; the first edge brings the node's two along, which length 4 or more holds too
        placed = ranked.select(*NODE, first.alias("pos"), text.alias("part"))
    else:
        chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct((first + i - 1).alias("pos"), F.substr(text, i, F.lit(1)).alias("part")))
        placed = ranked.select(*NODE, F.explode(chars).alias("c")).select(*NODE, "c.pos", "c.part")
    grouped = placed.groupBy(*NODE, F.expr(f"pos div {length}").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return grouped.select(*NODE, "chunk_no", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("chunk"))


def chunk_bag(edges: DataFrame, length: int) -> DataFrame:
    """gid, chunk, cnt."""
    return node_chunks(edges, length).groupBy("gid", "chunk").agg(F.count("*").alias("cnt"))


def vocabulary(bag: DataFrame) -> DataFrame:
    """chunk, chunk_id: ids from 0 in the order of the chunks. The distinct chunks alone are ordered."""
    distinct = bag.select("chunk").distinct()
    first = distinct.withColumn("head", F.substring("chunk", 1, 3))
    before = first.groupBy("head").count().select("head", (F.sum("count").over(W.orderBy("head")) - F.col("count")).alias("before"))
    return first.withColumn("r", F.row_number().over(W.partitionBy("head").orderBy("chunk"))).join(before, "head").select("chunk", (F.col("before") + F.col("r") - 1).cast("long").alias("chunk_id"))


def shingle_vectors(bag: DataFrame, vocab: DataFrame) -> DataFrame:
    """gid, chunk_id, cnt: the rows that are not zero."""
    return bag.join(vocab, "chunk").select("gid", "chunk_id", "cnt")


def graph_sizes(edges: DataFrame, max_edges: int | None = None) -> DataFrame:
    """gid, size: live edges of each graph after the last of a dense stream; at most max_edges are live over all graphs."""
    if max_edges is None:
        return edges.groupBy("gid").agg(F.count("*").alias("size"))
    last = edges.agg(F.max("seq").alias("_last"))
    live = (F.col("seq") > F.col("_last") - max_edges).cast("long")
    return edges.join(F.broadcast(last)).groupBy("gid").agg(F.sum(live).alias("size"))
