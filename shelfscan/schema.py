"""Table layouts of the raw and the clean listings."""

from __future__ import annotations

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("sku_id", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("mrp", T.IntegerType()),
        T.StructField("discount_percent", T.IntegerType()),
        T.StructField("discounted_selling_price", T.IntegerType()),
        T.StructField("weight_in_gms", T.IntegerType()),
        T.StructField("available_quantity", T.IntegerType()),
        T.StructField("out_of_stock", T.StringType()),
    ]
)

TEXT_COLUMNS = [f.name for f in RAW if isinstance(f.dataType, T.StringType)]
INT_COLUMNS = [f.name for f in RAW if isinstance(f.dataType, T.IntegerType)]

MONEY = T.DecimalType(10, 2)
PER_GRAM = T.DecimalType(10, 4)
REVENUE = T.DecimalType(12, 2)

CLEAN = T.StructType(
    [
        T.StructField("sku_id", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("mrp", MONEY),
        T.StructField("discount_percent", T.IntegerType()),
        T.StructField("discounted_selling_price", MONEY),
        T.StructField("weight_in_gms", T.IntegerType()),
        T.StructField("available_quantity", T.IntegerType()),
        T.StructField("out_of_stock", T.BooleanType()),
        T.StructField("price_per_gram", PER_GRAM),
        T.StructField("estimated_revenue", REVENUE),
    ]
)
