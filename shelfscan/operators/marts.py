"""Dashboard tables over the listings cleaned for the dashboard.

All summary tables can be read from one cube of the listings, so that these are scanned once
however many tables are written; product lists and the scatter points read the listings.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.functions import bands
from shelfscan.functions.exact import money, pct, ratio
from shelfscan.operators.cube import listings, measures, out_of_stock_listings, stock_cube
from shelfscan.sources import sinks, versions
from shelfscan.sources.workspace import materialize


def _by_category(cube: DataFrame) -> DataFrame:
    return (
        measures(cube)
        .groupBy("category")
        .agg(
            listings().alias("skus"),
            F.sum("sum_estimated_revenue").alias("revenue"),
            F.sum(F.when(~F.col("out_of_stock"), F.col("sum_value_at_mrp")).otherwise(0)).alias("value"),
            out_of_stock_listings().alias("oos"),
            F.sum("sum_discount_percent").alias("discount"),
        )
    )


def _cards(skus, revenue, value, oos, discount) -> list:
    return [
        skus.alias("total_skus"),
        money(revenue).alias("revenue"),
        money(value).alias("inventory_value"),
        oos.alias("oos_count"),
        F.coalesce(pct(oos, skus), F.lit(0.0)).alias("oos_rate"),
        ratio(discount, skus, 1).alias("avg_discount"),
    ]


CARD_SUMS = ["skus", "revenue", "value", "oos", "discount"]


def kpis(cube: DataFrame) -> DataFrame:
    """Headline figures over all listings; inventory value counts what is in stock."""
    return _by_category(cube).agg(*_cards(*[F.coalesce(F.sum(c), F.lit(0)) for c in CARD_SUMS]))


def kpis_by_category(cube: DataFrame) -> DataFrame:
    """The same figures for each category, as the category filter shows them."""
    return _by_category(cube).select("category", *_cards(*[F.col(c) for c in CARD_SUMS])).orderBy("category")


def categories(cube: DataFrame) -> DataFrame:
    return measures(cube).select("category").distinct().orderBy("category")


def revenue_by_category(cube: DataFrame) -> DataFrame:
    return (
        measures(cube)
        .groupBy("category")
        .agg(money(F.sum("sum_estimated_revenue")).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "category")
    )


def stockouts_by_category(cube: DataFrame) -> DataFrame:
    return (
        _by_category(cube)
        .select("category", pct(F.col("oos"), F.col("skus")).alias("oos_rate"))
        .orderBy(F.desc("oos_rate"), "category")
    )


def worst_stockouts(cube: DataFrame, n: int = 5) -> DataFrame:
    return stockouts_by_category(cube).limit(n)


def discount_distribution(cube: DataFrame, top_edge: int = 70) -> DataFrame:
    """Listings per ten-wide discount bucket up to ``top_edge``; empty buckets show 0."""
    edges = list(range(0, top_edge + 1, 10))
    discount = F.col("discount_percent")
    counts = measures(cube).agg(*[listings(discount.between(e, e + 9)).alias(f"n{e}") for e in edges])
    rows = [
        F.struct(F.lit(e).alias("bucket_start"), F.lit(f"{e}-{e + 9}%").alias("label"), F.col(f"n{e}").alias("n"))
        for e in edges
    ]
    return counts.select(F.inline(F.array(*rows)))


def discount_vs_stockouts(cube: DataFrame, tiers: list[bands.Band] = bands.DASHBOARD_TIERS) -> DataFrame:
    """Stock-out rate per discount tier, 0 for a tier without listings."""
    sums = []
    for i, tier in enumerate(tiers):
        held = bands.in_band(F.col("discount_percent"), tier)
        sums.append(listings(held).alias(f"total{i}"))
        sums.append(listings(held & F.col("out_of_stock")).alias(f"oos{i}"))
    rows = [
        F.struct(
            F.lit(i + 1).alias("tier_index"),
            F.lit(label).alias("label"),
            F.col(f"total{i}").alias("total"),
            F.col(f"oos{i}").alias("oos"),
            F.coalesce(pct(F.col(f"oos{i}"), F.col(f"total{i}")), F.lit(0.0)).alias("rate"),
        )
        for i, (label, _, _) in enumerate(tiers)
    ]
    return measures(cube).agg(*sums).select(F.inline(F.array(*rows)))


def outside_ranges(cube: DataFrame, top_edge: int = 70, tiers: list[bands.Band] = bands.DASHBOARD_TIERS) -> DataFrame:
    """Per discount table, how many listings lie outside its published range, and their highest discount."""
    discount = F.col("discount_percent")
    ranges = {"discount_distribution": (0, top_edge + 9), "discount_vs_oos": (tiers[0][1], tiers[-1][2])}
    sums, rows = [], []
    for i, (mart, (low, high)) in enumerate(ranges.items()):
        sums += [
            listings(~F.coalesce(discount.between(low, high), F.lit(False))).alias(f"n{i}"),
            F.max(F.when(discount > high, discount)).alias(f"high{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(mart).alias("mart"),
                F.col(f"n{i}").alias("listings_outside"),
                F.col(f"high{i}").alias("highest_discount"),
            )
        )
    return measures(cube).agg(*sums).select(F.inline(F.array(*rows)))


def discount_by_category(cube: DataFrame) -> DataFrame:
    return (
        measures(cube)
        .groupBy("category")
        .agg(ratio(F.sum("sum_discount_percent"), listings(), 1).alias("avg_discount"))
        .orderBy("category")
    )


def stock_by_category(cube: DataFrame) -> DataFrame:
    return (
        _by_category(cube)
        .select("category", (F.col("skus") - F.col("oos")).alias("in_stock"), F.col("oos").alias("out_of_stock"))
        .orderBy("category")
    )


def _product_columns() -> list:
    return [
        "name",
        "category",
        F.col("estimated_revenue").alias("revenue"),
        F.col("discount_percent").alias("discount"),
        F.col("available_quantity").alias("quantity"),
    ]


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("estimated_revenue"), "sku_id").limit(n).select(*_product_columns())


def top_products_by_category(df: DataFrame, n: int = 10) -> DataFrame:
    """The table the category filter shows, for every category at once."""
    best = Window.partitionBy("category").orderBy(F.desc_nulls_last("estimated_revenue"), "sku_id")
    return (
        df.select(*_product_columns(), F.row_number().over(best).alias("position"))
        .where(F.col("position") <= n)
        .orderBy("category", "position")
    )


def scatter(df: DataFrame) -> DataFrame:
    """One point per listing in stock with a price, none left out."""
    return df.where("NOT out_of_stock AND mrp > 0").select("mrp", "discount_percent", "category", "name")


CUBE_MARTS = {
    "kpis": kpis,
    "kpis_by_category": kpis_by_category,
    "categories": categories,
    "revenue_by_category": revenue_by_category,
    "oos_by_category": stockouts_by_category,
    "oos_top_categories": worst_stockouts,
    "discount_distribution": discount_distribution,
    "discount_vs_oos": discount_vs_stockouts,
    "outside_ranges": outside_ranges,
    "avg_discount_by_category": discount_by_category,
    "stock_by_category": stock_by_category,
}


def mart_writers(df: DataFrame, fmt: str = "parquet", all_rows: bool = True) -> dict[str, versions.Writer]:
    """A writer for every dashboard table; the cube is stored now and read by all summary tables."""
    cube = materialize(stock_cube(df), "cube")
    builds = {name: partial(build, cube) for name, build in CUBE_MARTS.items()}
    builds |= {
        "top_products": lambda: top_products(df),
        "top_products_by_category": lambda: top_products_by_category(df),
    }
    if all_rows:
        builds["all_rows"] = lambda: df
    writers = {name: versions.table(build, fmt) for name, build in builds.items()}
    return {**writers, "scatter": versions.table(lambda: scatter(df), fmt, "category")}


def write_marts(df: DataFrame, folder: str, fmt: str = "parquet", stored_at: str | None = None) -> dict[str, str]:
    """Write every dashboard table under ``folder``; returns name -> path.

    If the listings are stored already, ``stored_at`` is the table of all rows and no second copy
    is written. Each table is replaced by itself: where readers need all of one version, use
    ``publish_marts``. In JSON files amounts have no decimal type: give the reader a schema, else
    they come back as doubles.
    """
    writers = mart_writers(df, fmt, stored_at is None)
    written = sinks.run_all({name: partial(write, f"{folder}/{name}") for name, write in writers.items()})
    return {**({} if stored_at is None else {"all_rows": stored_at}), **{name: table.folder for name, table in written.items()}}


def publish_marts(df: DataFrame, root: str, fmt: str = "parquet") -> versions.Version:
    """All dashboard tables as one new version of the set at ``root``, or none of them."""
    return versions.publish_tables(df.sparkSession, root, mart_writers(df, fmt))
