"""Named value bands: discount brackets, stock-out tiers, weight tiers.

A band is ``(label, low, high)`` with both ends included and ``None`` for an open end. Rows
outside every band get a NULL band, as an unmatched CASE would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Band = tuple[str, "int | None", "int | None"]

# Labels and edges of the published reports.
DISCOUNT_BRACKETS: list[Band] = [
    ("0% (No discount)", 0, 0),
    ("1-10%", 1, 10),
    ("11-20%", 11, 20),
    ("21-30%", 21, 30),
    ("31-40%", 31, 40),
    ("41-50%", 41, 50),
    ("51-60%", 51, 60),
    ("61-70%", 61, 70),
    ("70%+", 71, None),
]
STOCKOUT_TIERS: list[Band] = [*DISCOUNT_BRACKETS[:5], (">40%", 41, None)]
DASHBOARD_TIERS: list[Band] = [
    ("0%", 0, 0),
    ("1-10%", 1, 10),
    ("11-20%", 11, 20),
    ("21-30%", 21, 30),
    ("31-40%", 31, 40),
    (">40%", 41, 100),
]
WEIGHT_TIERS: list[Band] = [
    ("Ultra Light (<100g)", None, 99),
    ("Light (100-250g)", 100, 250),
    ("Medium (251-500g)", 251, 500),
    ("Heavy (501-1000g)", 501, 1000),
    ("Bulk (>1kg)", 1001, None),
]


def numbered(bands: list[Band]) -> list[Band]:
    """The same bands with their position written in front of the label."""
    return [(f"{i}. {label}", low, high) for i, (label, low, high) in enumerate(bands, 1)]


def in_band(col: Column, band: Band) -> Column:
    _, low, high = band
    if low is None:
        return col <= high
    if high is None:
        return col >= low
    return col.between(low, high)


def band_index(col: Column, bands: list[Band]) -> Column:
    """1-based position of the band that holds ``col``, NULL if none does."""
    first, *rest = [(in_band(col, band), i) for i, band in enumerate(bands, 1)]
    chain = F.when(*first)
    for condition, i in rest:
        chain = chain.when(condition, i)
    return chain


def band_label(index: Column, bands: list[Band]) -> Column:
    return F.get(F.array(*[F.lit(label) for label, _, _ in bands]), index - 1)


def decade(col: Column) -> Column:
    """Lower edge of the ten-wide bin that holds ``col``."""
    return (col - F.pmod(col, F.lit(10))).cast("int")
