"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.shipping import ship
from edgeloom.storage import shared_dir, stored

__all__ = ["BATCH_ROWS", "crc_mod", "id_and_text", "keeps", "map_batches", "shared_dir", "stored", "table", "texts_of", "tokenizer_path", "without_keys"]

#: Rows, and bytes of Arrow data, that a function gets at once. Spark's own batches are bounded in bytes by the application's
#: spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless it says otherwise), which is never changed here.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads: other columns, whatever their names, never meet its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def slices(batch: pa.RecordBatch, rows: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and, but for single rows that are larger, about `size` bytes."""
    at, n = 0, batch.num_rows
    while at < n:
        take = min(rows, n - at)
        while take > 1 and batch.slice(at, take).nbytes > size:
            take = max(1, take // 2)
        yield batch.slice(at, take)
        at += take


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """fn over parts of Arrow batches, of at most `rows` rows and about BATCH_BYTES bytes each. No setting of the session is touched."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(fn.__module__)
        for batch in batches:
            for part in slices(batch, rows):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        batch = part = out = None
        give_back()

    return df.mapInArrow(run, schema)


#: How each module forgets what its tasks keep in a Python worker from one task to the next.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, forget: Callable[[], None]) -> None:
    _kept[module] = forget


def forget_others(module: str) -> None:
    """A worker goes from stage to stage: it keeps the tables of the operator it works for alone."""
    for name, forget in _kept.items():
        if name != module:
            forget()


def give_back() -> None:
    """Memory that a task has freed goes back to the system, as idle workers stand beside those that run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc(), "malloc_trim", None):
        trim(0)


@functools.lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A null text is an empty one."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


#: Ids up to which those to be taken out are sent to every task, instead of shuffling the texts to meet them.
BROADCAST_IDS = 500_000


def without_keys(docs: DataFrame, ids: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs for which the keys (by column of ids) are not among the distinct ids; all columns stay. A null is a value."""
    ids = stored(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, [key.eqNullSafe(ids[name]) for name, key in keys.items()], "left_anti")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the folds of the learned operators. A null id falls in no fold (null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: below EDGELOOM_TOKENIZERS if that is set, else from the public_tokenizers package."""
    if root := os.environ.get("EDGELOOM_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
