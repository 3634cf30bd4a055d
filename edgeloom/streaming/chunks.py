"""The parallel half of the stream: chunk deltas with state per source node.

The source's seq is dense over the stream, as in batches, so which edges are live is known without any state that nodes share. A node's state holds
the live edges' seq (or only their number, where nothing is evicted) and what the last two chunks need. seq + 1 is the stream's event time as well, in milliseconds: once
the watermark has passed the last edge that was live, the node's state is dropped, whether or not the node ever gets another edge.
Edges come in order of seq from one micro-batch to the next; within one they may come in any order. For many nodes, set spark.sql.streaming.stateStore.providerClass to RocksDB's.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.operators.shingles import NODE
from edgeloom.shipping import ship

EDGE_SCHEMA = "seq long, src_id long, src_type string, dst_id long, dst_type string, e_type string, gid int"
DELTAS = "seq long, gid int, n long, in_chunk string, out_chunk string, full_chunk string"


class Node:
    """A source node's live out-edges."""

    __slots__ = ("count", "live", "recent")

    def __init__(self, held: int):
        self.count, self.live, self.recent = 0, deque(), deque(maxlen=held)

    def add(self, seq: int, text: str, max_edges: int | None) -> int:
        """The number of live edges after this one."""
        self.recent.append(text)
        if max_edges is None:
            self.count += 1
            return self.count
        self.live.append(seq)
        while self.live[0] <= seq - max_edges:
            self.live.popleft()
        return len(self.live)


def chunks_after(node: Node, n: int, src_type: str, c: int, consistent: bool) -> tuple[str, str | None, str | None]:
    """in_chunk, out_chunk, full_chunk after an edge that made n edges live."""
    mine = list(node.recent)[-n:]
    tail = (f" {src_type}" if n <= node.recent.maxlen else "") + "".join(mine)
    last = (2 * n + 1) % c + 1
    coming, before = tail[-last:], tail[-last - c : -last]
    if n == 1 or last == 2:
        return coming, None, None
    if last == 1:
        return coming, before[:-1], before if consistent else None
    return coming, coming[:-2], None


def read_edge_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Edges from Parquet files as they come."""
    return spark.readStream.schema(EDGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_chunk_deltas(edges: DataFrame, config: Config) -> DataFrame:
    """The stream's rows of operators.deltas.chunk_deltas, per micro-batch in no order."""
    c, held, most, consistent = config.chunk_length, config.chunk_length + 2, config.max_edges, config.odd_chunk_mode == "consistent"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # all its edges are dead
            state.remove()
            return
        gid, kind = int(key[0]), key[2]
        node: Node = pickle.loads(state.get[0]) if state.exists else Node(held)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, to, edge in zip(rows.seq.tolist(), rows.dst_type, rows.e_type, strict=True):
            n = node.add(seq, edge + to, most)
            out.append((seq, gid, n, *chunks_after(node, n, kind, c, consistent)))
        state.update((pickle.dumps(node),))
        if most is not None:
            state.setTimeoutTimestamp(max(seq + 1 + most, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["seq", "gid", "n", "in_chunk", "out_chunk", "full_chunk"])

    ship(edges.sparkSession)
    if most is None:
        return edges.groupBy(*NODE).applyInPandasWithState(update, DELTAS, "node binary", "append", "NoTimeout")
    timed = edges.withColumn("at", F.timestamp_millis(F.col("seq") + 1)).withWatermark("at", "0 seconds")
    return timed.groupBy(*NODE).applyInPandasWithState(update, DELTAS, "node binary", "append", "EventTimeTimeout")
