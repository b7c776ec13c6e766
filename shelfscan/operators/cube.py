"""One small summary table that most reports can be read from.

A report over counts, sums and averages gives the same figures from the listings as from a cube
of them. ``measures`` shows a listing as a cube cell of one; ``stock_cube`` adds cells up, so
that many reports share one scan of the listings. The cube has at most a few thousand cells per
category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions import bands
from shelfscan.functions.exact import ratio

DIMENSIONS = ["category", "discount_percent", "out_of_stock", "weight_tier", "priced"]
AVERAGED = [
    "mrp",
    "discounted_selling_price",
    "discount_percent",
    "available_quantity",
    "price_per_gram",
    "estimated_revenue",
]
RANGED = ["mrp", "available_quantity", "price_per_gram"]
SKETCH = "name_sketch"
SKETCH_BITS = 12


def measures(df: DataFrame, *more: str) -> DataFrame:
    """Clean listings as cube cells, with ``more`` of their columns; a cube is returned as it is."""
    if "listings" in df.columns:
        return df
    quantity = F.col("available_quantity")
    wide = {"discount_percent", "available_quantity"}
    return df.select(
        *more,
        "category",
        "discount_percent",
        "out_of_stock",
        bands.band_index(F.col("weight_in_gms"), bands.WEIGHT_TIERS).alias("weight_tier"),
        F.coalesce(F.col("mrp") > 0, F.lit(False)).alias("priced"),
        F.lit(1).cast("bigint").alias("listings"),
        F.coalesce(F.col("estimated_revenue") > 0, F.lit(False)).cast("bigint").alias("earning"),
        (F.col("mrp") * quantity).alias("sum_value_at_mrp"),
        (F.col("discounted_selling_price") * quantity).alias("sum_value_at_price"),
        *[(F.col(c).cast("bigint") if c in wide else F.col(c)).alias(f"sum_{c}") for c in AVERAGED],
        *[F.col(c).isNotNull().cast("bigint").alias(f"n_{c}") for c in AVERAGED],
        *[F.col(c).alias(f"min_{c}") for c in RANGED],
        *[F.col(c).alias(f"max_{c}") for c in RANGED],
    )


def stock_cube(df: DataFrame, sketch_names: bool = False) -> DataFrame:
    """Listings, or the cells of a cube, added up by DIMENSIONS.

    With ``sketch_names`` each cell also has a sketch of the distinct names in it, some
    2 ** SKETCH_BITS bytes at most, from which ``distinct_names`` can tell how many there are in
    any part of the cube without another look at the listings.
    """
    cells = measures(df)
    combine = {"min": F.min, "max": F.max}
    sums = [combine.get(c.split("_")[0], F.sum)(c).alias(c) for c in cells.columns if c not in [*DIMENSIONS, SKETCH]]
    if SKETCH in cells.columns:
        sums.append(F.hll_union_agg(SKETCH).alias(SKETCH))
        return cells.groupBy(*DIMENSIONS).agg(*sums)
    if sketch_names:
        cells = measures(df, "name")
        sums.append(F.hll_sketch_agg("name", F.lit(SKETCH_BITS)).alias(SKETCH))
    return cells.groupBy(*DIMENSIONS).agg(*sums)


def distinct_names(cube_or_listings: DataFrame, by: list[str]) -> DataFrame:
    """``by`` (dimensions of the cube, perhaps none) and unique_products, the number of distinct names.

    Exact from listings, where names are shuffled; estimated from a cube that sketches them, with
    a standard error of 1.04 / sqrt(2 ** SKETCH_BITS) or 1.6 %.
    """
    df = cube_or_listings
    if SKETCH in df.columns:
        return df.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias("unique_products"))
    if "listings" in df.columns:
        raise ValueError("the cube was made without sketches of names")
    cells = measures(df, "name").select(*by, "name").distinct()
    return cells.groupBy(*by).agg(F.count("name").alias("unique_products"))


def listings(where: Column | None = None) -> Column:
    """Number of listings (that meet ``where``), as an aggregate."""
    counted = F.col("listings") if where is None else F.when(where, F.col("listings"))
    return F.coalesce(F.sum(counted), F.lit(0))


def out_of_stock_listings() -> Column:
    return listings(F.col("out_of_stock"))


def average(column: str, digits: int, where: Column | None = None) -> Column:
    """Mean of the known values of a listing column, as an aggregate."""
    total, n = F.col(f"sum_{column}"), F.col(f"n_{column}")
    if where is not None:
        total, n = F.when(where, total), F.when(where, n)
    return ratio(F.sum(total), F.sum(n), digits)
