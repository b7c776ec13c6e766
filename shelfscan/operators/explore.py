"""Distributions and summary statistics of the clean listings.

All but ``summary_statistics`` also accept a cube of the listings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.functions import bands
from shelfscan.functions.exact import money, pct, ratio, to_code
from shelfscan.operators.cube import average, listings, measures, out_of_stock_listings
from shelfscan.operators.median import summarise
from shelfscan.operators.totals import with_totals

# Report label, column and smallest-unit factor of each summarised measure.
SUMMARY_METRICS = [
    ("MRP (₹)", "mrp", 100),
    ("Selling Price (₹)", "discounted_selling_price", 100),
    ("Discount %", "discount_percent", 1),
]


def stock_status():
    return F.when(F.col("out_of_stock"), "Out of Stock").otherwise("In Stock")


def summary_statistics(df: DataFrame, metrics: list[tuple[str, str, int]] = SUMMARY_METRICS) -> DataFrame:
    """Count, range, mean, median and sample deviation of several columns together."""
    values = [
        F.struct(F.lit(i).alias("metric"), to_code(F.col(c), unit).alias("code"))
        for i, (_, c, unit) in enumerate(metrics, 1)
    ]
    measured = df.select(F.inline(F.array(*values)))
    unit = F.get(F.array(*[F.lit(u) for _, _, u in metrics]), F.col("metric") - 1)
    spread = F.sqrt(F.col("squares") / F.nullif(F.col("n") - 1, F.lit(0))) / unit
    positions = df.sparkSession.range(1, len(metrics) + 1, numPartitions=1)
    every_metric = positions.select(F.col("id").cast("int").alias("metric"))
    # the broadcast side has one row per metric
    return (
        every_metric.join(F.broadcast(summarise(measured, ["metric"], F.col("code"))), "metric", "left")
        .orderBy("metric")
        .select(
            F.get(F.array(*[F.lit(label) for label, _, _ in metrics]), F.col("metric") - 1).alias("metric"),
            F.coalesce("n", F.lit(0)).alias("count"),
            (F.col("min_code") / unit).alias("min_val"),
            (F.col("max_code") / unit).alias("max_val"),
            ratio(F.col("sum_code"), F.col("n") * unit, 2).alias("mean_val"),
            ratio(F.col("lower") + F.col("upper"), 2 * unit, 2).alias("median_val"),
            F.round(spread, 2).alias("std_dev"),
        )
    )


def sku_distribution(df: DataFrame) -> DataFrame:
    groups = measures(df).groupBy("category").agg(listings().alias("total_skus"))
    return (
        with_totals(groups, "total_skus")
        .select("category", "total_skus", pct(F.col("total_skus"), F.col("total_total_skus")).alias("pct_of_total"))
        .orderBy(F.desc("total_skus"), "category")
    )


def discount_brackets(df: DataFrame) -> DataFrame:
    index = bands.band_index(F.col("discount_percent"), bands.DISCOUNT_BRACKETS)
    groups = measures(df).groupBy(index.alias("bracket")).agg(listings().alias("product_count"))
    return (
        with_totals(groups, "product_count")
        .orderBy(F.asc_nulls_last("bracket"))
        .select(
            F.col("bracket").alias("position"),
            bands.band_label(F.col("bracket"), bands.DISCOUNT_BRACKETS).alias("discount_bracket"),
            "product_count",
            pct(F.col("product_count"), F.col("total_product_count")).alias("pct_of_total"),
        )
    )


def stock_share(df: DataFrame) -> DataFrame:
    groups = measures(df).groupBy("out_of_stock").agg(listings().alias("sku_count"))
    return with_totals(groups, "sku_count").select(
        stock_status().alias("stock_status"),
        "sku_count",
        pct(F.col("sku_count"), F.col("total_sku_count")).alias("pct_of_total"),
    )


def stock_by_category(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .groupBy("category")
        .agg(listings().alias("total_skus"), out_of_stock_listings().alias("oos_skus"))
        .withColumn("oos_rate_pct", pct(F.col("oos_skus"), F.col("total_skus")))
        .orderBy(F.desc("oos_rate_pct"), "category")
    )


def weight_tiers(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .groupBy("weight_tier")
        .agg(
            listings().alias("product_count"),
            average("mrp", 2).alias("avg_mrp"),
            average("discounted_selling_price", 2).alias("avg_selling_price"),
        )
        .orderBy(F.asc_nulls_last("weight_tier"))
        .withColumns(
            {"position": F.col("weight_tier"), "weight_tier": bands.band_label(F.col("weight_tier"), bands.WEIGHT_TIERS)}
        )
    )


def price_per_gram_by_category(df: DataFrame) -> DataFrame:
    return (
        measures(df)
        .where("n_price_per_gram > 0")
        .groupBy("category")
        .agg(
            average("price_per_gram", 4).alias("avg_price_per_gram"),
            money(F.min("min_price_per_gram")).alias("min_price_per_gram"),
            money(F.max("max_price_per_gram")).alias("max_price_per_gram"),
        )
        .orderBy(F.desc("avg_price_per_gram"), "category")
    )


def revenue_potential(df: DataFrame) -> DataFrame:
    return measures(df).agg(
        money(F.sum("sum_estimated_revenue")).alias("total_potential_revenue"),
        average("estimated_revenue", 2).alias("avg_revenue_per_sku"),
        F.coalesce(F.sum("earning"), F.lit(0)).alias("revenue_generating_skus"),
    )


def revenue_by_category(df: DataFrame) -> DataFrame:
    groups = measures(df).groupBy("category").agg(F.sum("sum_estimated_revenue").alias("revenue"))
    return (
        with_totals(groups, "revenue")
        .select(
            "category",
            money(F.col("revenue")).alias("category_revenue"),
            pct(F.col("revenue"), F.col("total_revenue")).alias("pct_of_total_revenue"),
        )
        .orderBy(F.desc_nulls_first("category_revenue"), "category")
    )
