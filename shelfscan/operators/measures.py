"""BI-tool measures. The first three read lightly cleaned listings; the others raw ones, as
the chart tool does: prices in rupees and a boolean flag, but nothing filled or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.bands import decade
from shelfscan.functions.exact import money
from shelfscan.operators.cleaning import typed


def _sale_value() -> Column:
    return F.when(~F.col("out_of_stock"), F.col("discounted_selling_price") * F.col("available_quantity"))


def _stockout_fraction() -> Column:
    """Out-of-stock share of all rows, 0 when there are none."""
    rows = F.count("*")
    return F.when(rows > 0, F.count_if("out_of_stock") / F.nullif(rows, F.lit(0))).otherwise(0.0)


def total_skus(df: DataFrame) -> DataFrame:
    return df.agg(F.count("sku_id").alias("total_skus"))


def revenue(df: DataFrame) -> DataFrame:
    """Selling price times stock over the listings in stock."""
    return df.agg(money(F.sum(_sale_value())).alias("est_revenue"))


def stockout_rate(df: DataFrame) -> DataFrame:
    return df.agg(_stockout_fraction().alias("out_of_stock_rate"))


def row_level_revenue(raw: DataFrame) -> DataFrame:
    """Rupee prices and revenue next to each raw listing; revenue is 0 when out of stock."""
    return typed(raw).select(
        "sku_id",
        F.col("mrp").alias("mrp_rupees"),
        F.col("discounted_selling_price").alias("selling_price_rupees"),
        F.when(F.col("out_of_stock"), F.lit(0)).otherwise(_sale_value()).alias("estimated_revenue"),
    )


def by_category(df: DataFrame) -> DataFrame:
    """Revenue and stock-out rate per category, for a treemap and a bar chart."""
    return df.groupBy("category").agg(
        money(F.coalesce(F.sum(_sale_value()), F.lit(0))).alias("estimated_revenue"),
        _stockout_fraction().alias("out_of_stock_rate"),
    )


def discount_bins(df: DataFrame) -> DataFrame:
    """Listings per ten-wide discount bin; those without a discount are a bin of their own."""
    return df.groupBy(decade(F.col("discount_percent")).alias("bin_start")).agg(F.count("sku_id").alias("skus"))
