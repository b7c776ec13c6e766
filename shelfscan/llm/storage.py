"""Intermediate tables in the shared folder, and joins whose small side is measured first."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.sources.workspace import fresh_path

#: Rows of at most 16 bytes that may be broadcast: 4 MB.
BROADCAST_ROWS = 250_000


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and return a frame that reads it."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that are stored and done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def measured(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of ids with the hint that its number of rows allows."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
