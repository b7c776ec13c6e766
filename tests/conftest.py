from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfscan import schema  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.fixture
def raw(spark):
    """Build raw listings from dicts; columns left out get harmless values."""

    def build(*rows: dict):
        base = {
            "category": "A",
            "name": "thing",
            "mrp": 1000,
            "discount_percent": 10,
            "discounted_selling_price": 900,
            "weight_in_gms": 100,
            "available_quantity": 5,
            "out_of_stock": "False",
        }
        full = [{"sku_id": f"S{i:03d}", **base, **row} for i, row in enumerate(rows)]
        names = schema.RAW.fieldNames()
        nullable = schema.T.StructType([schema.T.StructField(f.name, f.dataType) for f in schema.RAW])
        return spark.createDataFrame([tuple(row[n] for n in names) for row in full], nullable)

    return build


def column(df, name, key="sku_id"):
    return [r[name] for r in df.orderBy(key).collect()]
