"""Grand totals next to grouped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(groups: DataFrame, *measures: str) -> DataFrame:
    """Add ``total_<measure>``, the sum over all rows of ``groups``, to every row.

    The sums are a one-row subquery over the same grouped plan. Name every measure of
    ``groups``, needed or not: the subquery then has the same shuffle as the grouping, which
    Spark runs once for both, and the grouped rows are never gathered in one task as an
    unpartitioned window would.
    """
    row = groups.agg(F.struct(*[F.sum(m).alias(m) for m in measures])).scalar()
    return groups.withColumns({f"total_{m}": row.getField(m) for m in measures})
