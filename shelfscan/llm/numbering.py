"""Global numbers of rows in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm.storage import partitions, store

_PLACE_BITS = 33  # of Spark's row ids: the row's place in its partition


def dealt_by_range(rows: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """Stored ``rows``, sorted, with part (the range a row is in) and place (from 0 inside its range).

    Ranges follow ``order``. Rows that are equal in all of it lie in one range, so ``order`` has to
    end with something that tells repeated rows apart if there may be very many. The written table
    fixes the places: a lost executor changes none of them.
    """
    row = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", row)
    part, place = F.shiftright("place", _PLACE_BITS), F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return store(ranged.withColumns({"part": part, "place": place}), label)


def totals_before(dealt: DataFrame, amount: Column | None = None) -> DataFrame:
    """One row per range: part, rows_before, and, with ``amount``, own (its sum in the range) and before."""
    sums = [F.count("*").alias("rows")] + ([F.sum(amount).alias("own")] if amount is not None else [])
    parts = dealt.groupBy("part").agg(*sums)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("rows_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    if amount is not None:
        out = out.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    return out.drop("rows")


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their number (from 1) in ``order`` as column ``name``."""
    dealt = dealt_by_range(rows, order, f"dealt_{name}")
    bases = F.broadcast(totals_before(dealt))  # one row per range
    return dealt.join(bases, "part").withColumn(name, F.col("rows_before") + F.col("place") + 1).select(*rows.columns, name)
