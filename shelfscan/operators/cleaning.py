"""Turning raw listings into clean ones.

Every step is a function of a DataFrame, applied in the order of ``clean``; nothing is updated
in place, so the same raw table always gives the same clean table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan import schema
from shelfscan.functions.exact import to_code
from shelfscan.operators.lookup import BROADCAST_BYTES, attach
from shelfscan.operators.median import summarise

PRICES = ["mrp", "discounted_selling_price"]


def fill_discounts(df: DataFrame) -> DataFrame:
    """A discount that was not recorded counts as none. The selling price stays as it is."""
    return df.fillna(0, ["discount_percent"])


def category_weights(df: DataFrame, mode: str = "interpolated") -> DataFrame:
    """``category, median_weight`` over the listings with a known weight.

    ``interpolated`` averages the two middle weights and rounds a half to the even gram;
    ``upper`` takes the upper of the two.
    """
    known = df.where("weight_in_gms IS NOT NULL")
    middle = summarise(known, ["category"], F.col("weight_in_gms").cast("bigint"))
    value = F.col("upper") if mode == "upper" else F.rint((F.col("lower") + F.col("upper")) / 2)
    return middle.select("category", value.cast("int").alias("median_weight"))


def fill_weights(
    df: DataFrame,
    mode: str = "interpolated",
    fallback: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """An unknown weight becomes the median of its category.

    With a ``fallback``, that value stands in where the category has no known weight or a
    median of 0; without one such a weight stays NULL.
    """
    median = F.col("median_weight")
    if fallback is not None:
        median = F.coalesce(F.nullif(median, F.lit(0)), F.lit(fallback))
    unknown = F.col("weight_in_gms").isNull()
    joined = attach(df, category_weights(df, mode), "category", unknown, broadcast_bytes=broadcast_bytes)
    return joined.withColumn("weight_in_gms", F.coalesce("weight_in_gms", median)).select(df.columns)


def drop_unpriced(df: DataFrame, drop_null: bool = False) -> DataFrame:
    """Drop listings with a list price of 0; an unknown price stays unless ``drop_null``."""
    priced = F.col("mrp") != 0
    return df.where(priced if drop_null else priced | F.col("mrp").isNull())


def fix_negative_discounts(df: DataFrame) -> DataFrame:
    """A negative discount becomes 0 and the listing sells at list price."""
    negative = F.col("discount_percent") < 0
    return df.withColumns(
        {
            "discounted_selling_price": F.when(negative, F.col("mrp")).otherwise(F.col("discounted_selling_price")),
            "discount_percent": F.when(negative, F.lit(0)).otherwise(F.col("discount_percent")),
        }
    )


def to_major_units(df: DataFrame) -> DataFrame:
    """Prices from whole paise to rupees with two decimals."""
    return df.withColumns({c: (F.col(c) * F.lit(Decimal("0.01"))).cast(schema.MONEY) for c in PRICES})


def flag_to_boolean(df: DataFrame) -> DataFrame:
    """Only the exact text ``True`` means out of stock; anything else, NULL too, is in stock."""
    return df.withColumn("out_of_stock", F.coalesce(F.col("out_of_stock") == "True", F.lit(False)))


def add_price_per_gram(df: DataFrame, otherwise: int | None = None) -> DataFrame:
    """Selling price over weight, rounded half away from zero to four decimals; ``otherwise``
    where the weight is not positive.

    The quotient is taken in whole ten-thousandths, so that no earlier rounding can tip a tie,
    and of the price without its sign, since a whole division cuts towards zero.
    """
    weight = F.col("weight_in_gms").cast("bigint")
    paise = to_code(F.col("discounted_selling_price"), 100)
    whole = F.call_function("div", F.abs(paise) * 200 + weight, 2 * weight)
    value = F.when(weight > 0, F.when(paise < 0, -whole).otherwise(whole)) * F.lit(Decimal("0.0001"))
    if otherwise is not None:
        value = F.when(weight > 0, value).otherwise(F.lit(otherwise))
    return df.withColumn("price_per_gram", value.cast(schema.PER_GRAM))


def add_estimated_revenue(df: DataFrame) -> DataFrame:
    """Selling price times stock: what the listing earns if all units sell."""
    return df.withColumn(
        "estimated_revenue",
        (F.col("discounted_selling_price") * F.col("available_quantity")).cast(schema.REVENUE),
    )


def repair(df: DataFrame) -> DataFrame:
    """The listing after missing and invalid values are dealt with, prices still in paise."""
    return fix_negative_discounts(drop_unpriced(fill_weights(fill_discounts(df))))


def clean(df: DataFrame) -> DataFrame:
    """The clean listings all analysis reads.

    Weight medians are taken before unpriced listings are dropped, so those still count.
    """
    return add_estimated_revenue(add_price_per_gram(typed(repair(df)))).select(schema.CLEAN.fieldNames())


def repair_discounts_for_dashboard(df: DataFrame) -> DataFrame:
    """Drop unpriced listings, then repair discounts; a missing quantity or price counts as 0."""
    priced = drop_unpriced(df.fillna(0, ["available_quantity"]), drop_null=True)
    return fix_negative_discounts(fill_discounts(priced)).fillna(0, ["discounted_selling_price"])


def repair_for_dashboard(df: DataFrame, fallback_weight: int = 500) -> DataFrame:
    """As ``repair``, but unpriced listings go first and the upper median fills weights."""
    return fill_weights(repair_discounts_for_dashboard(df), mode="upper", fallback=fallback_weight)


def clean_for_dashboard(df: DataFrame, fallback_weight: int = 500) -> DataFrame:
    """The clean listings behind the dashboard tables: no NULL price per gram."""
    priced = add_price_per_gram(typed(repair_for_dashboard(df, fallback_weight)), otherwise=0)
    return add_estimated_revenue(priced).select(schema.CLEAN.fieldNames())


def typed(df: DataFrame) -> DataFrame:
    """Raw listings with prices in rupees and a boolean stock flag; nothing filled or dropped."""
    return flag_to_boolean(to_major_units(df))


def clean_light(df: DataFrame) -> DataFrame:
    """The short preparation for BI tools: no weight fill and no negative-discount repair."""
    return drop_unpriced(typed(fill_discounts(df)))
