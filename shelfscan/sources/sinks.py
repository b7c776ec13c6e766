"""Writing result tables, and reading those kept in folders by value."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan.sources import files

#: Stands for the empty text in a folder's name, and before a text that begins with it.
EMPTY_MARK = "∅"


def _parts(path: str) -> tuple[str, str]:
    """The folder that ``path`` lies in, without a slash at its end, and its name."""
    parent, slash, name = path.rstrip("/").rpartition("/")
    return parent if slash else ".", name


def _beside(path: str, kind: str) -> tuple[str, str]:
    """A hidden folder next to ``path``, and the place of a table in it."""
    parent, name = _parts(path)
    folder = f"{parent}/_{kind}-{name}-{uuid.uuid4().hex}"
    return folder, f"{folder}/{name}"


def put_back(spark: SparkSession, path: str) -> None:
    """Undo a replacement that was cut off between its two renames: nothing at ``path``, the old table beside it."""
    parent, name = _parts(path)
    if files.exists(spark, path):
        return
    for folder in sorted(n for n in files.names(spark, parent or "/") if n.startswith(f"_old-{name}-")):
        if files.exists(spark, f"{parent}/{folder}/{name}"):
            files.move(spark, f"{parent}/{folder}/{name}", path)
            files.remove(spark, f"{parent}/{folder}")
            return


def staged(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Replace the table at ``path`` by what ``write`` puts into the folder that it is given.

    The new table is written beside the old one, which stays until the new one is whole, so
    ``write`` may read it; then two renames swap them. If ``write`` fails, the old table is as it
    was. Where readers must never meet the moment between the renames, use ``versions``.
    """
    put_back(spark, path)
    folder, place = _beside(path, "new")
    with files.removed_on_failure(spark, folder):
        write(place)
        if not files.exists(spark, path):
            files.make_folder(spark, _parts(path)[0] or "/")
            files.move(spark, place, path)
        else:
            old_folder, old = _beside(path, "old")
            files.make_folder(spark, old_folder)
            files.move(spark, path, old)
            try:
                files.move(spark, place, path)
            except BaseException:
                put_back(spark, path)
                raise
            files.remove(spark, old_folder)
    files.remove(spark, folder)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Replace the table at ``path``; running it again leaves the same table, and a failure the one before."""
    return staged(df.sparkSession, path, lambda place: df.write.format(fmt).save(place))


def run_all(jobs: dict[str, Callable[[], object]], at_once: int = 4) -> dict:
    """What each function returns, some side by side; all have ended when this returns or raises."""
    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def write_tables(
    tables: dict[str, Callable[[], DataFrame]], folder: str, fmt: str = "parquet", at_once: int = 4
) -> dict[str, str]:
    """Replace ``folder/<name>`` by what each function returns; small jobs run side by side.

    Some reports run jobs while they are built, so they are built in the pool too.
    """
    return run_all({n: (lambda n=n, build=build: write_table(build(), f"{folder}/{n}", fmt)) for n, build in tables.items()}, at_once)


def _folder_value(column: str) -> Column:
    """A text as a folder's name can hold it: Spark has one name for NULL and the empty text."""
    text = F.col(column)
    return F.when((text == "") | text.startswith(EMPTY_MARK), F.concat(F.lit(EMPTY_MARK), text)).otherwise(text)


def _from_folder(column: str) -> Column:
    text = F.col(column)
    return F.when(text.startswith(EMPTY_MARK), F.substring(text, 2, 1 << 30)).otherwise(text)


def write_partitioned(df: DataFrame, path: str, column: str, fmt: str = "parquet") -> str:
    """Replace a table kept in one folder per value of ``column``.

    The rebalance hint lets adaptive execution gather small values into one file each and
    split a value that holds much of the data over several tasks. The empty text gets a folder of
    its own, apart from NULL's; ``read_partitioned`` gives it back as it was.
    """
    text = isinstance(df.schema[column].dataType, T.StringType)
    rows = df.withColumn(column, _folder_value(column)) if text else df
    rows = rows.hint("rebalance", column)
    return staged(df.sparkSession, path, lambda place: rows.write.format(fmt).partitionBy(column).save(place))


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType, column: str, fmt: str = "parquet") -> DataFrame:
    """A table of ``write_partitioned`` with its values and types as they were. A filter on ``column`` skips folders."""
    df = spark.read.schema(schema).format(fmt).load(path)
    text = isinstance(schema[column].dataType, T.StringType)
    return (df.withColumn(column, _from_folder(column)) if text else df).select(*schema.fieldNames())


def one_value(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """The rows of ``read_partitioned`` with ``value``; NULL finds NULL."""
    return df.where(F.col(column).eqNullSafe(F.lit(value)))
