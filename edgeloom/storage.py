"""Tables that are written once to the folder which driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows up to which a table may be sent to every task by way of the driver.
SENT = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and the driver is the only machine (tests, the command line on a local master)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"spark.checkpoint.dir is unset: tables between stages need a folder that all machines of {sc.master} share")
        found = "file://" + tempfile.mkdtemp(prefix="edgeloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Written once as Parquet to the shared folder and read back: a lost executor costs no recomputation, and later joins see plain
    scans whose sizes are known. The tables stay below <shared folder>/edgeloom-<application id> until that is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/edgeloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(rows: DataFrame, n: int, most: int = SENT) -> DataFrame:
    """The n rows of one side of a join: up to `most`, how they meet the other side is left to Spark; more are dealt out with it. Spark goes by the bytes of
    a stored table, and few distinct labels make those a small part of what the rows take in the driver's memory."""
    return rows if n <= most else rows.hint("merge")
