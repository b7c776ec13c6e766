"""Exact decimal arithmetic for report figures.

Sums stay DECIMAL or BIGINT; a figure is rounded once, half away from zero, from the exact
quotient, and only then becomes a double. Rounding a double quotient instead would depend on
how the tie happens to be stored in binary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,4)"


def ratio(num: Column, den: Column, digits: int = 0) -> Column:
    """``num / den`` rounded to ``digits`` places; NULL where ``den`` is 0."""
    unit = 10**digits
    n, d = num.cast(_WIDE), den.cast(_WIDE)
    doubled = F.abs(n) * F.lit(2 * unit) + F.abs(d)
    whole = F.call_function("div", doubled.cast(_WIDE), F.nullif(F.abs(d) * F.lit(2), F.lit(0)).cast(_WIDE))
    sign = F.when((n < 0) != (d < 0), -1.0).otherwise(1.0)
    return sign * whole.cast("double") / F.lit(float(unit))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` as a percentage of ``whole``."""
    return ratio(part.cast(_WIDE) * F.lit(100), whole, digits)


def mean(col: Column, digits: int) -> Column:
    """Average of the non-NULL values of ``col``, as an aggregate."""
    return ratio(F.sum(col), F.count(col), digits)


def money(col: Column) -> Column:
    """An exact money amount as a double, for reports."""
    return col.cast("double")


def to_code(col: Column, unit: int) -> Column:
    """A fixed-point value as a whole number of its smallest unit (rupees -> paise)."""
    return (col * F.lit(unit)).cast("bigint")

