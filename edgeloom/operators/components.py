"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import SENT, unsent, stored


def components(nodes: DataFrame, edges: DataFrame, sent: int = SENT) -> DataFrame:
    """nodes: node (distinct), label; edges: a, b -> node, label: the smallest label of its component, root: the smallest node that has it there.

    Each round takes the smallest (label, node) among the neighbours, then follows it to what that node has found (pointer
    jumping), so long chains take about log2 of their length. Labels only ever get smaller, so it settles however many rounds that takes.
    Every round is stored in the shared folder; only whether anything moved comes to the driver. A hub's links are taken together
    before the shuffle (a minimum), and a join in which one has most rows is split by adaptive execution. Of more than `sent` nodes no table is sent to every task.
    """
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    state = stored(nodes.select("node", F.struct("label", "node").alias("best")))
    n = state.count()
    while True:
        least = both.join(unsent(state.select(F.col("node").alias("v"), "best"), n, sent), "v").groupBy("u").agg(F.min("best").alias("seen"))
        step = stored(state.join(unsent(least, n, sent), state["node"] == least["u"], "left").select("node", "best", F.least("best", F.coalesce("seen", "best")).alias("next")))
        jump = step.select(F.col("node").alias("to"), F.col("next").alias("far"))
        after = stored(step.join(unsent(jump, n, sent), F.col("next.node") == F.col("to")).select("node", F.least("next", "far").alias("best"), (F.col("next") != F.col("best")).alias("moved")))
        state = after.select("node", "best")
        if after.filter("moved").isEmpty():
            return state.select("node", "best.label", F.col("best.node").alias("root"))
