"""Orders over all rows and within keys, without sending a whole table or a hot key to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Span of seq that is ranked at once.
BLOCK = 1 << 20


def dense_seq(df: DataFrame, seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """df with seq replaced by 0, 1, 2, ... in its order; seq is unique and not null. Rows are ranked within blocks of seq; only the counts of the blocks meet in one task."""
    held = df.withColumn("_block", F.expr(f"{seq} div {block}"))
    counts = held.groupBy("_block").count()
    before = counts.select("_block", (F.sum("count").over(W.orderBy("_block")) - F.col("count")).alias("_before"))
    ranked = held.withColumn("_rank", F.row_number().over(W.partitionBy("_block").orderBy(seq)))
    return ranked.join(before, "_block").withColumn(seq, (F.col("_before") + F.col("_rank") - 1).cast("long")).select(*df.columns)


def rank_within(df: DataFrame, keys: list[str], seq: str = "seq", rank: str = "k", block: int = BLOCK) -> DataFrame:
    """df with the rank (from 0) of each row within its keys by seq. A hot key is split by blocks of seq, so no task ranks all of it."""
    held = df.withColumn("_block", F.expr(f"{seq} div {block}"))
    counts = held.groupBy(*keys, "_block").count()
    before = counts.select(*keys, "_block", (F.sum("count").over(W.partitionBy(*keys).orderBy("_block")) - F.col("count")).alias("_before"))
    ranked = held.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_block").orderBy(seq)))
    return ranked.join(before, [*keys, "_block"]).withColumn(rank, F.col("_before") + F.col("_rank") - 1).drop("_block", "_before", "_rank")


def with_context(df: DataFrame, at: str, size: int, reach: int) -> DataFrame:
    """df by blocks (_block) of `size` values of the long column `at`, each with the rows of the block before that are within `reach` of its start.
    The rows that are in their own block have _own. A window over a key and its block then needs no more rows than these, however hot the key is."""
    size = max(size, reach)
    block = F.expr(f"{at} div {size}")
    both = F.when(F.col(at) % size >= size - reach, F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == block)
