"""Tables as streams, to hold streaming queries against batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.operators.online import Fold
from edgeloom.storage import shared_dir, stored
from edgeloom.streaming.chunks import DELTAS, read_edge_stream, stream_chunk_deltas
from edgeloom.streaming.online import Periodic, read_snapshots, read_states, start_online


def own_folder(df: DataFrame) -> str:
    spark = df.sparkSession
    return f"{shared_dir(spark).rstrip('/')}/edgeloom-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def arrive(edges: DataFrame, folder: str, parts: int = 4) -> None:
    """Writes dense edges below folder in `parts` steps of seq, one after another, as a source would."""
    edges = stored(edges)
    last = edges.agg(F.max("seq")).first()[0]
    step = (last or 0) // parts + 1
    for k in range(parts):
        edges.filter(F.col("seq").between(k * step, k * step + step - 1)).coalesce(1).write.mode("append").parquet(folder)


def streamed_chunk_deltas(edges: DataFrame, config: Config, parts: int = 4) -> DataFrame:
    """operators.deltas.chunk_deltas of a dense table, by Structured Streaming over its rows as they arrive."""
    folder = own_folder(edges)
    arrive(edges, f"{folder}/edges", parts)
    moved = stream_chunk_deltas(read_edge_stream(edges.sparkSession, f"{folder}/edges"), config)
    query = moved.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return edges.sparkSession.read.schema(DELTAS).parquet(f"{folder}/out")


def streamed_online_clusters(edges: DataFrame, fold: Fold, parts: int = 4) -> DataFrame:
    """operators.online.online_clusters of a dense table, by Structured Streaming over its rows as they arrive."""
    folder = own_folder(edges)
    arrive(edges, f"{folder}/edges", parts)
    moved = stream_chunk_deltas(read_edge_stream(edges.sparkSession, f"{folder}/edges"), fold.config)
    start_online(moved, fold, f"{folder}/state", f"{folder}/out").awaitTermination()
    return read_states(edges.sparkSession, f"{folder}/out")


def streamed_snapshots(edges: DataFrame, fold: Fold, scores: DataFrame, parts: int = 4) -> DataFrame:
    """operators.snapshots.snapshots of a dense table, emitted by Structured Streaming while its rows arrive. scores: of the listed graphs, before."""
    folder = own_folder(edges)
    arrive(edges, f"{folder}/edges", parts)
    moved = stream_chunk_deltas(read_edge_stream(edges.sparkSession, f"{folder}/edges"), fold.config)
    # the graphs are those of a run, as the listed ones are: the fold holds each of them anyway
    periodic = Periodic(fold.config.snapshot_interval, {r["gid"]: r["score"] for r in scores.collect()}, [r["gid"] for r in edges.select("gid").distinct().collect()])
    start_online(moved, fold, f"{folder}/state", f"{folder}/out", periodic).awaitTermination()
    return read_snapshots(edges.sparkSession, f"{folder}/out", f"{folder}/state", periodic)
