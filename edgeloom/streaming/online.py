"""The sequential half of the stream: clusters shared by all graphs, folded micro-batch by micro-batch.

Centroids move with every edge, so each micro-batch is folded in order of seq by one task. The state before and after a batch is a file named by the batch, in the
shared folder: a batch that is run again starts from the same state and writes the same rows, so results are exactly once.

Every `interval` edges all graphs' clusters and scores are emitted, as the batch operator's snapshots have them; the snapshot after the last edge follows when the stream has ended.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom.files import opened, write_file
from edgeloom.operators.online import Fold, fold_rows, shown
from edgeloom.shipping import ship

STATES = "seq long, gid int, cluster_id int, score double"
SNAPSHOTS = "interval int, gid int, cluster_id int, score double"


@dataclass
class Periodic:
    """What snapshots need to know: their interval, the listed graphs' scores before the stream, and the graphs that are streamed (those that have not come yet are shown as unseen)."""

    interval: int
    scores: dict[int, float]
    gids: list[int]


def state_path(folder: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/fold-{batch + 1:012d}.pickle"


def load(folder: str, batch: int) -> Fold:
    with opened(state_path(folder, batch)) as (read, size):
        return pickle.loads(read(0, size))


def _snapshot_rows(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [("seq", pa.int64(), [None] * len(rows)), ("interval", pa.int32(), columns[0]), ("gid", pa.int32(), columns[1]), ("cluster_id", pa.int32(), columns[2]), ("score", pa.float64(), columns[3])]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for _, k, v in kinds], names=[n for n, _, _ in kinds])


def fold_batch(deltas: DataFrame, batch: int, folder: str, periodic: Periodic | None = None) -> DataFrame:
    """seq, interval, gid, cluster_id, score: the state after each edge of a micro-batch (interval null), and all graphs' after each edge that is a multiple of the interval (seq null).
    The state after the batch is written when its last row has been folded."""
    ship(deltas.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = load(folder, batch - 1)
        for rows in batches:
            seqs, at = rows.column(0).to_numpy(), 0
            due = (np.flatnonzero(seqs % periodic.interval == 0) + 1).tolist() if periodic else []
            for end in [*due, rows.num_rows]:
                if end > at:
                    done = fold_rows(fold, rows.slice(at, end - at))
                    yield pa.RecordBatch.from_arrays([done.column(0), pa.nulls(done.num_rows, pa.int32()), *done.columns[1:]], names=["seq", "interval", "gid", "cluster_id", "score"])
                    if periodic and seqs[end - 1] % periodic.interval == 0:
                        yield _snapshot_rows(shown(fold, int(seqs[end - 1]) // periodic.interval, periodic.scores, periodic.gids))
                at = end
        write_file(state_path(folder, batch), pickle.dumps(fold))

    rows = deltas.select("seq", "gid", "in_chunk", "full_chunk", "out_chunk").repartition(1).sortWithinPartitions("seq")
    return rows.mapInArrow(run, "seq long, interval int, gid int, cluster_id int, score double")


def start_online(deltas: DataFrame, fold: Fold, folder: str, out: str, periodic: Periodic | None = None, **trigger) -> StreamingQuery:
    """Folds a stream of chunk deltas and writes the states after each edge, and the snapshots, below `out`, a folder per micro-batch in each. folder: for states and the checkpoint."""
    write_file(state_path(folder, -1), pickle.dumps(fold))
    out = out.rstrip("/")

    def each(rows: DataFrame, batch: int) -> None:
        # written once, as the fold is one pass: states and snapshots are told apart by the folder kind=
        found = fold_batch(rows, batch, folder, periodic).withColumn("kind", F.when(F.col("interval").isNull(), "states").otherwise("snapshots"))
        found.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={batch}")

    return deltas.writeStream.outputMode("append").option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


def read_states(spark: SparkSession, out: str) -> DataFrame:
    """seq, gid, cluster_id, score after each edge."""
    return _written(spark, out).filter("kind = 'states'").select("seq", "gid", "cluster_id", "score")


def read_snapshots(spark: SparkSession, out: str, folder: str, periodic: Periodic) -> DataFrame:
    """interval, gid, cluster_id, score of every snapshot of a stream that has ended: the last one is that after the last edge."""
    rows = _written(spark, out)
    edges = (rows.agg(F.max("seq")).first()[0] or 0) + 1 if not rows.filter("kind = 'states'").isEmpty() else 0
    n = -(-edges // periodic.interval)
    batches = rows.agg(F.max("batch")).first()[0]
    kept = rows.filter((F.col("kind") == "snapshots") & (F.col("interval") < n - 1)).select("interval", "gid", "cluster_id", "score")
    if not n:
        return kept
    last = spark.createDataFrame(shown(load(folder, batches), n - 1, periodic.scores, periodic.gids), SNAPSHOTS)
    return kept.unionByName(last)


def _written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("seq long, interval int, gid int, cluster_id int, score double, batch int, kind string").parquet(out)
