"""Business questions over the clean listings.

Reports of sums and averages also accept a cube of the listings; product lists, medians and
distinct counts need the listings. Thresholds and list lengths are parameters. Where the order of a list is not settled by the
sort keys alone, ``sku_id`` decides.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.functions import bands
from shelfscan.functions.exact import mean, money, pct, ratio, to_code
from shelfscan.operators.cube import average, listings, measures, out_of_stock_listings
from shelfscan.operators.explore import stock_status
from shelfscan.operators.median import summarise
from shelfscan.operators.ranking import ranked_with_running_total, value_slices
from shelfscan.operators.totals import with_totals


def in_stock(df: DataFrame) -> DataFrame:
    return df.where("NOT out_of_stock")


def markdown() -> Column:
    return F.col("mrp") - F.col("discounted_selling_price")


def oos_rate(rows: str, oos: str) -> Column:
    return pct(F.col(oos), F.col(rows))


# --- discounts ---------------------------------------------------------------------------


def top_discounts(df: DataFrame, n: int = 10) -> DataFrame:
    return (
        df.where("discount_percent > 0")
        .withColumn("discount_amount", markdown())
        .orderBy(F.desc("discount_percent"), F.desc_nulls_first("discount_amount"), "sku_id")
        .limit(n)
        .select("name", "category", "discount_percent", "mrp", "discounted_selling_price", "discount_amount")
    )


def discount_by_category(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .groupBy("category")
        .agg(
            average("discount_percent", 1).alias("avg_discount_pct"),
            listings().alias("total_skus"),
            F.min("discount_percent").cast("double").alias("min_discount"),
            F.max("discount_percent").cast("double").alias("max_discount"),
        )
        .orderBy(F.desc_nulls_first("avg_discount_pct"), "category")
    )


def premium_low_discount(df: DataFrame, min_mrp: int = 500, max_discount: int = 10, n: int = 20) -> DataFrame:
    return (
        df.where((F.col("mrp") > min_mrp) & (F.col("discount_percent") < max_discount))
        .orderBy(F.desc("mrp"), "sku_id")
        .limit(n)
        .select(
            "name",
            "category",
            "mrp",
            "discount_percent",
            "discounted_selling_price",
            "available_quantity",
            "out_of_stock",
        )
    )


def stockouts_by_discount_tier(df: DataFrame) -> DataFrame:
    index = bands.band_index(F.col("discount_percent"), bands.STOCKOUT_TIERS)
    return (
        measures(df)
        .groupBy(index.alias("tier"))
        .agg(listings().alias("total_products"), out_of_stock_listings().alias("oos_count"))
        .orderBy(F.asc_nulls_last("tier"))
        .select(
            F.col("tier").alias("position"),
            bands.band_label(F.col("tier"), bands.STOCKOUT_TIERS).alias("discount_tier"),
            "total_products",
            "oos_count",
            oos_rate("total_products", "oos_count").alias("oos_rate_pct"),
        )
    )


def largest_markdowns(df: DataFrame, n: int = 15) -> DataFrame:
    return (
        df.where("mrp > 0")
        .withColumn("absolute_markdown", markdown())
        .orderBy(F.desc_nulls_first("absolute_markdown"), "sku_id")
        .limit(n)
        .select(
            "name",
            "category",
            "mrp",
            "discounted_selling_price",
            "absolute_markdown",
            "discount_percent",
            "available_quantity",
        )
    )


def discount_histogram(df: DataFrame) -> DataFrame:
    # integer division by ten truncates, as the bins are defined
    bracket = F.call_function("div", F.col("discount_percent"), F.lit(10)).cast("int")
    return (
        measures(df)
        .groupBy((bracket * 10).alias("discount_bracket_start"))
        .agg(
            listings().alias("product_count"),
            average("available_quantity", 0).alias("avg_stock_in_bracket"),
            out_of_stock_listings().alias("oos"),
        )
        .select(
            "discount_bracket_start",
            (F.col("discount_bracket_start") + 9).alias("discount_bracket_end"),
            "product_count",
            "avg_stock_in_bracket",
            oos_rate("product_count", "oos").alias("oos_rate_pct"),
        )
        .orderBy(F.asc_nulls_last("discount_bracket_start"))
    )


def deep_discounts(df: DataFrame, above: int = 60) -> DataFrame:
    """Every listing discounted by more than ``above`` percent, in order, without a limit."""
    return (
        df.where(F.col("discount_percent") > above)
        .withColumn("margin_lost", markdown())
        .orderBy(F.desc("discount_percent"), F.desc_nulls_first("margin_lost"), "sku_id")
        .select(
            "name",
            "category",
            "mrp",
            "discount_percent",
            "discounted_selling_price",
            "margin_lost",
            "available_quantity",
            "out_of_stock",
        )
    )


# --- stock -------------------------------------------------------------------------------


def _stockouts_by_category(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .groupBy("category")
        .agg(listings().alias("total_skus"), out_of_stock_listings().alias("oos_count"))
        .withColumn("oos_rate_pct", oos_rate("total_skus", "oos_count"))
    )


def stockout_ranking(df: DataFrame) -> DataFrame:
    """Categories ranked by their unrounded out-of-stock rate; equal rates share a rank."""
    # the window sees one row per category
    by_rate = Window.orderBy((F.col("oos_count") / F.col("total_skus")).desc())
    return (
        _stockouts_by_category(df)
        .withColumn("oos_rank", F.rank().over(by_rate))
        .orderBy(F.desc("oos_rate_pct"), "category")
    )


def critical_categories(df: DataFrame, above: int = 50) -> DataFrame:
    """Categories whose unrounded out-of-stock rate is above ``above`` percent."""
    return _stockouts_by_category(df).where(F.col("oos_count") * 100 > F.col("total_skus") * above)


def quantity_by_category(df: DataFrame) -> DataFrame:
    return (
        in_stock(measures(df))
        .groupBy("category")
        .agg(
            average("available_quantity", 0).alias("avg_quantity"),
            F.min("min_available_quantity").alias("min_quantity"),
            F.max("max_available_quantity").alias("max_quantity"),
            F.sum("sum_available_quantity").alias("total_units"),
        )
        .orderBy(F.desc_nulls_first("avg_quantity"), "category")
    )


def cheap_and_stocked(df: DataFrame, max_price: int = 50, n: int = 15) -> DataFrame:
    return (
        in_stock(df)
        .where(F.col("discounted_selling_price") < max_price)
        .orderBy(F.desc_nulls_first("available_quantity"), "sku_id")
        .limit(n)
        .select("name", "category", "discounted_selling_price", "available_quantity", "estimated_revenue")
    )


def stock_comparison(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .groupBy("out_of_stock")
        .agg(
            listings().alias("sku_count"),
            average("discount_percent", 1).alias("avg_discount_pct"),
            average("mrp", 2).alias("avg_mrp"),
            average("discounted_selling_price", 2).alias("avg_selling_price"),
        )
        .select(stock_status().alias("stock_status"), "sku_count", "avg_discount_pct", "avg_mrp", "avg_selling_price")
    )


def lost_revenue(df: DataFrame) -> DataFrame:
    """What the out-of-stock listings would earn at their category's usual price and stock.

    The usual price and stock are averages over the in-stock listings, rounded before use.
    Both sides are counted in one grouping, so no join is needed: a category appears if it has
    listings on both sides.
    """
    stocked = ~F.col("out_of_stock")
    groups = (
        measures(df)
        .where("category IS NOT NULL")
        .groupBy("category")
        .agg(
            out_of_stock_listings().alias("oos_sku_count"),
            listings(stocked).alias("stocked"),
            average("discounted_selling_price", 2, stocked).alias("avg_category_price"),
            average("available_quantity", 0, stocked).alias("avg_category_qty"),
        )
        .where("oos_sku_count > 0 AND stocked > 0")
    )
    price = F.round(F.col("avg_category_price") * 100).cast("decimal(18,0)")
    quantity = F.col("avg_category_qty").cast("decimal(18,0)")
    lost = (F.col("oos_sku_count").cast("decimal(18,0)") * price * quantity).cast("decimal(38,0)")
    return groups.select(
        "category",
        "oos_sku_count",
        "avg_category_price",
        "avg_category_qty",
        ratio(lost, F.lit(100), 2).alias("estimated_lost_revenue"),
    ).orderBy(F.desc_nulls_first("estimated_lost_revenue"), "category")


# --- value and revenue -------------------------------------------------------------------


def revenue_by_category_in_stock(df: DataFrame) -> DataFrame:
    groups = (
        in_stock(measures(df))
        .groupBy("category")
        .agg(
            F.sum("sum_estimated_revenue").alias("revenue"),
            listings().alias("total_skus"),
            F.sum("n_estimated_revenue").alias("with_revenue"),
        )
    )
    return (
        with_totals(groups, "revenue", "total_skus", "with_revenue")
        .select(
            "category",
            money(F.col("revenue")).alias("total_revenue"),
            "total_skus",
            ratio(F.col("revenue"), F.col("with_revenue"), 2).alias("avg_revenue_per_sku"),
            pct(F.col("revenue"), F.col("total_revenue")).alias("revenue_share_pct"),
        )
        .orderBy(F.desc_nulls_first("total_revenue"), "category")
    )


def best_value(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` in-stock listings of each category with the lowest price per gram.

    Catalyst keeps only the first ``n`` rows per category of each task before the shuffle.
    """
    cheapest = Window.partitionBy("category").orderBy("price_per_gram", "sku_id")
    return (
        in_stock(df)
        .where("price_per_gram > 0")
        .select(
            "category",
            "name",
            "weight_in_gms",
            "discounted_selling_price",
            "price_per_gram",
            F.row_number().over(cheapest).alias("value_rank"),
        )
        .where(F.col("value_rank") <= n)
        .orderBy("category", "value_rank")
    )


def top_inventory_value(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        in_stock(measures(df))
        .groupBy("category")
        .agg(
            F.sum("sum_value_at_mrp").alias("at_mrp"),
            F.sum("sum_value_at_price").alias("at_selling"),
            F.sum("sum_available_quantity").alias("total_units"),
        )
        .orderBy(F.desc_nulls_first("at_selling"), "category")
        .limit(n)
        .select(
            "category",
            money(F.col("at_mrp")).alias("total_inventory_value_mrp"),
            money(F.col("at_selling")).alias("total_inventory_value_selling"),
            "total_units",
            money(F.col("at_mrp") - F.col("at_selling")).alias("discount_cost"),
        )
    )


def weight_tier_pricing(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .groupBy("weight_tier")
        .agg(
            listings().alias("sku_count"),
            average("mrp", 2).alias("avg_mrp"),
            average("discounted_selling_price", 2).alias("avg_selling_price"),
            average("discount_percent", 1).alias("avg_discount_pct"),
            average("price_per_gram", 4).alias("avg_price_per_gram"),
        )
        .orderBy(F.asc_nulls_last("weight_tier"))
        .withColumn("weight_tier", bands.band_label(F.col("weight_tier"), bands.numbered(bands.WEIGHT_TIERS)))
    )


def price_range(df: DataFrame) -> DataFrame:
    """Lowest, highest, mean and exact median selling price of each category."""
    paise = F.lit(100)
    return (
        summarise(df, ["category"], to_code(F.col("discounted_selling_price"), 100))
        .select(
            "category",
            (F.col("min_code") / paise).alias("min_price"),
            (F.col("max_code") / paise).alias("max_price"),
            ((F.col("max_code") - F.col("min_code")) / paise).alias("price_spread"),
            ratio(F.col("sum_code"), F.col("n") * 100, 2).alias("avg_price"),
            ratio(F.col("lower") + F.col("upper"), F.lit(200), 2).alias("median_price"),
        )
        .orderBy(F.desc_nulls_first("price_spread"), "category")
    )


def revenue_retention(df: DataFrame) -> DataFrame:
    """Share of list-price value that remains after discounts, per category."""
    return (
        in_stock(measures(df))
        .where("priced")
        .groupBy("category")
        .agg(
            F.sum("sum_estimated_revenue").alias("revenue"),
            F.sum("sum_value_at_mrp").alias("at_mrp"),
            average("discount_percent", 1).alias("avg_discount_pct"),
            listings().alias("total_skus"),
        )
        .select(
            "category",
            money(F.col("revenue")).alias("total_revenue"),
            money(F.col("at_mrp")).alias("total_mrp_value"),
            pct(F.col("revenue"), F.col("at_mrp")).alias("revenue_retention_pct"),
            "avg_discount_pct",
            "total_skus",
        )
        .orderBy(F.desc_nulls_first("revenue_retention_pct"), "category")
    )


def executive_summary(df: DataFrame) -> DataFrame:
    """Ten headline figures in one row.

    Sums and averages are one plain aggregate, combined in each task. The two distinct counts
    are one-row subqueries, so only categories and names are shuffled, each alone.
    """
    stocked = F.when(~F.col("out_of_stock"), F.col("available_quantity"))
    figures = df.agg(
        F.count("*").alias("total_skus"),
        money(F.sum("estimated_revenue")).alias("total_potential_revenue"),
        money(F.sum(F.col("mrp") * F.col("available_quantity"))).alias("total_inventory_at_mrp"),
        mean(F.col("discount_percent"), 1).alias("avg_discount_pct"),
        F.count_if("out_of_stock").alias("total_oos_skus"),
        pct(F.count_if("out_of_stock"), F.count("*")).alias("oos_rate_pct"),
        mean(stocked, 0).alias("avg_stock_level"),
        mean(F.col("price_per_gram"), 4).alias("avg_price_per_gram"),
    )
    return figures.withColumns(
        {
            "total_categories": df.select("category").distinct().agg(F.count("category")).scalar(),
            "unique_products": df.select("name").distinct().agg(F.count("name")).scalar(),
        }
    )


def pareto(df: DataFrame, top_share: float = 0.2, limit: int | None = 20) -> DataFrame:
    """The best-earning ``top_share`` of listings, or the ``limit`` first of them, in order, with
    the revenue share reached at each.

    Listings with equal revenue share one cumulative figure. Calling this runs jobs.
    """
    earning = df.where("estimated_revenue > 0").select("sku_id", "name", "category", "estimated_revenue")
    slices = value_slices(earning, "estimated_revenue")
    total, count = slices.agg(F.sum("amount"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = math.ceil(count * Decimal(str(top_share)))
    wanted = wanted if limit is None else min(wanted, limit)
    ranked = ranked_with_running_total(earning, slices, "estimated_revenue", "sku_id", wanted)
    return ranked.select(
        ratio(F.col("rank") * 100, F.lit(count), 0).alias("product_percentile"),
        "name",
        "category",
        F.col("estimated_revenue").alias("revenue"),
        pct(F.col("running_total"), F.lit(total)).alias("cumulative_revenue_pct"),
    )


# --- findings ----------------------------------------------------------------------------


def discount_stockout_ratio(df: DataFrame) -> DataFrame:
    """How many times likelier a stock-out is above 40% discount than without any."""
    discount = F.col("discount_percent")
    deep, none = discount > 40, discount == 0
    counts = measures(df).agg(
        listings(deep).alias("deep"),
        listings(deep & F.col("out_of_stock")).alias("deep_oos"),
        listings(none).alias("none"),
        listings(none & F.col("out_of_stock")).alias("none_oos"),
    )
    return counts.select(
        pct(F.col("deep_oos"), F.col("deep")).alias("deep_oos_rate_pct"),
        pct(F.col("none_oos"), F.col("none")).alias("undiscounted_oos_rate_pct"),
        ratio(
            F.col("deep_oos").cast("decimal(17,0)") * F.col("none").cast("decimal(17,0)"),
            F.col("none_oos").cast("decimal(17,0)") * F.col("deep").cast("decimal(17,0)"),
            2,
        ).alias("oos_ratio"),
    )


def leading_category_share(df: DataFrame, n: int = 2) -> DataFrame:
    """Revenue share of the ``n`` best-earning categories together."""
    groups = in_stock(measures(df)).groupBy("category").agg(F.sum("sum_estimated_revenue").alias("revenue"))
    top = with_totals(groups, "revenue").orderBy(F.desc_nulls_last("revenue"), "category").limit(n)
    return top.agg(pct(F.sum("revenue"), F.max("total_revenue")).alias("revenue_share_pct"))


def deep_discount_count(df: DataFrame, above: int = 60) -> DataFrame:
    return measures(df).agg(listings(F.col("discount_percent") > above).alias("deep_discount_skus"))


def total_lost_revenue(df: DataFrame) -> DataFrame:
    lost = lost_revenue(df).agg(F.sum(F.col("estimated_lost_revenue").cast("decimal(28,2)")).alias("lost"))
    return lost.select(money(F.col("lost")).alias("total_lost_revenue"))


def overall_stockout_rate(df: DataFrame) -> DataFrame:
    return measures(df).agg(pct(out_of_stock_listings(), listings()).alias("oos_rate_pct"))
