"""Raw listings derived from the ``lineitem`` and ``part`` tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan import schema


#: Up to here on either side of 0 the sums of multiples of two keys fit in BIGINT.
SMALL_KEYS = 10**16


def input_paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "part")]


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per (part, supplier) pair.

    The line items are combined before anything is shuffled, and the join to ``part`` carries
    no hint: Catalyst knows both file sizes, and adaptive execution splits skewed part keys.
    Keys are taken as BIGINT, whatever whole numbers the files hold, and any BIGINT will do.
    """
    lineitem, parts = (spark.read.parquet(path) for path in input_paths(sf_dir))
    offers = (
        lineitem
        .groupBy(F.col("l_partkey").cast("bigint").alias("p"), F.col("l_suppkey").cast("bigint").alias("s"))
        .agg(F.min("l_extendedprice").alias("ext"), F.sum("l_quantity").cast("bigint").alias("q"))
    )
    part = parts.select(
        F.col("p_partkey").cast("bigint").alias("p"), "p_name", "p_type", "p_size"
    )
    p, s = F.col("p"), F.col("s")
    small = p.between(-SMALL_KEYS, SMALL_KEYS) & s.between(-SMALL_KEYS, SMALL_KEYS)

    def rest(a: int, b: int, divisor: int) -> Column:
        """``(a * p + b * s) % divisor``, exact also where the sum is beyond BIGINT."""
        bigint, wide = (((a * p.cast(t) + b * s.cast(t)) % divisor).cast("bigint") for t in ("bigint", "decimal(20,0)"))
        return F.when(small, bigint).otherwise(wide)

    base_discount = (
        F.when(rest(31, 37, 100) < 15, 35 + rest(13, 7, 36))
        .when(rest(31, 37, 100) < 20, F.lit(0))
        .otherwise(1 + rest(13, 7, 35))
    )
    stockout_odds = 12 + F.col("d") / 2 + F.when(F.col("p_type") == "PROMO", 35).otherwise(0)
    listing = (
        offers.join(part, "p")
        .withColumns(
            {
                "m": 1000 + F.round(F.col("ext") * 100).cast("bigint") % 199001,
                "d": base_discount,
                "zero": rest(7, 3, 100) == 9,
                "neg": rest(3, 11, 200) == 7,
            }
        )
        .withColumn("oos", rest(17, 29, 100) < stockout_odds)
    )
    m, d, zero, neg, oos = (F.col(c) for c in ("m", "d", "zero", "neg", "oos"))
    columns = {
        "sku_id": F.concat(F.lit("SKU"), F.lpad(p.cast("string"), 7, "0"), F.lit("-"), F.lpad(s.cast("string"), 5, "0")),
        "category": F.col("p_type"),
        "name": F.col("p_name"),
        "mrp": F.when(zero, F.lit(0)).otherwise(m),
        "discount_percent": F.when(neg, -(1 + p % 10)).when(rest(5, 1, 20) != 0, d),
        "discounted_selling_price": F.when(zero, F.lit(0))
        .when(neg, m + 100)
        .otherwise(F.call_function("div", m * (100 - d), F.lit(100))),
        "weight_in_gms": F.when(rest(1, 7, 20) != 3, F.col("p_size") * 60),
        "available_quantity": F.when(oos, F.lit(0)).otherwise(1 + F.col("q") % 200),
        "out_of_stock": F.when(oos, "True").otherwise("False"),
    }
    return listing.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.RAW])
