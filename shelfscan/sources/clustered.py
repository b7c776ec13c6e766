"""Listings laid out so that a top list reads few files.

Rows are dealt into files by range of a group and a value, the largest first, and a small table
says what each file holds: its rows, its groups and its values from least to largest. A list of
the largest values of one group, or of all, needs only the files of that group whose values reach
up to what the best files are known to have.

    path/rows     the listings
    path/files    one row per file
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscan.sources import sinks


def write(df: DataFrame, path: str, group: str, value: str, key: str = "sku_id", files: int | None = None) -> str:
    """Replace the table at ``path``. ``files`` is the number of ranges, by default that of shuffle partitions.

    Ranges end with ``key``, so a group or a value that holds much of the rows is spread over files.
    """
    spark = df.sparkSession
    order = [F.asc_nulls_first(group), F.desc_nulls_last(value), F.col(key)]
    ranges = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(place: str) -> None:
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(f"{place}/rows")
        rows = spark.read.schema(df.schema).parquet(f"{place}/rows")
        held = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count(value).alias("values"),
            F.count_if(F.col(group).isNull()).alias("without_group"),
            F.min(group).alias("first_group"),
            F.max(group).alias("last_group"),
            F.min(value).alias("least"),
            F.max(value).alias("largest"),
        )
        held.coalesce(1).write.parquet(f"{place}/files")

    return sinks.staged(spark, path, written)


def _whole(of: str | None, everything: bool) -> tuple[Column, Column]:
    """Whether a file may hold rows of the group, and whether it holds no others."""
    if everything:
        return F.lit(True), F.lit(True)
    if of is None:
        return F.col("without_group") > 0, F.col("first_group").isNull()
    within = (F.col("first_group") <= of) & (F.col("last_group") >= of)
    return within, (F.col("first_group") == of) & (F.col("last_group") == of) & (F.col("without_group") == 0)


def needed_files(spark: SparkSession, path: str, n: int, of: str | None = None, everything: bool = False) -> list[str]:
    """The files that can hold one of the ``n`` largest values of group ``of`` (None: of no group), or of all rows."""
    may, only = _whole(of, everything)
    held = spark.read.parquet(f"{path}/files").where(may)
    # files of this group alone, best first, until they have n values: none of the n is below their least
    best = Window.orderBy(F.desc("least"), "file").rowsBetween(Window.unboundedPreceding, -1)  # over one row per file
    counted = held.where(only & (F.col("values") > 0)).withColumn("before", F.coalesce(F.sum("values").over(best), F.lit(0)))
    enough = counted.where(F.col("before") < n).agg(F.sum("values").alias("values"), F.min("least").alias("least")).first()
    if enough["values"] is not None and enough["values"] >= n:
        held = held.where(F.col("largest") >= F.lit(enough["least"]))
    return sorted(r["file"] for r in held.select("file").collect())


def candidates(
    spark: SparkSession, path: str, group: str, n: int, of: str | None = None, everything: bool = False
) -> DataFrame:
    """Rows of group ``of``, or of all with ``everything``, with all that the ``n`` largest values need, from few files."""
    names = needed_files(spark, path, n, of, everything)
    rows = spark.read.parquet(f"{path}/rows")
    found = spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{name}" for name in names]) if names else rows.limit(0)
    return found if everything else found.where(F.col(group).eqNullSafe(F.lit(of)))
