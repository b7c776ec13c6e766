"""Operators against their SQL on listings with every kind of gap and oddity.

The listings derived from the test tables are disturbed by a hash of their key: missing values
in every column, odd stock flags, discounts beyond all brackets, weights of 0 and below, negative prices, a
category without known weights, one without stock, and one that holds most rows.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import marts
from shelfscan.operators.cube import stock_cube
from shelfscan.plans import oracle, reports, tables
from shelfscan.plans.catalog import CATALOG, _doubles
from shelfscan.sources.driver_tables import raw_listings
from shelfscan.sources.workspace import materialize
from tests.conftest import DATA
from tests.test_oracle import _sorted
from tests.test_order import ordered

# the CSV round trips have tests of their own
NAMES = [n for n in CATALOG if not n.startswith(("s01", "s02", "s03", "s04", "s05"))]


def _disturbed(spark):
    raw = raw_listings(spark, DATA)

    def one_in(n, salt):
        return F.pmod(F.xxhash64("sku_id", F.lit(salt)), F.lit(n)) == 0

    raw = raw.withColumn(
        "category",
        F.when(one_in(2, "hot"), "HOT")
        .when(one_in(23, "category"), None)
        .when(one_in(31, "unweighed"), "UNWEIGHED")
        .when(one_in(37, "gone"), "GONE")
        .when(one_in(41, "unpriced"), "UNPRICED")
        .otherwise(F.col("category")),
    )
    category = F.col("category")
    raw = raw.withColumns(
        {
            "name": F.when(one_in(19, "name"), None).otherwise(F.col("name")),
            "mrp": F.when(one_in(17, "mrp"), None).when(one_in(47, "below"), -F.col("mrp")).otherwise(F.col("mrp")),
            "discount_percent": F.when(one_in(13, "deep"), 75)
            .when(one_in(29, "deeper"), 105)
            .otherwise(F.col("discount_percent")),
            "discounted_selling_price": F.when(one_in(11, "price") | (category == "UNPRICED"), None)
            .when(one_in(10, "refund"), -F.col("discounted_selling_price"))
            .otherwise(F.col("discounted_selling_price")),
            "weight_in_gms": F.when(category == "UNWEIGHED", None)
            .when(one_in(14, "weightless"), 0)
            .when(one_in(43, "negative"), -5)
            .otherwise(F.col("weight_in_gms")),
            "available_quantity": F.when(one_in(9, "quantity"), None).otherwise(F.col("available_quantity")),
            "out_of_stock": F.when(category == "GONE", "True")
            .when(one_in(12, "flag"), "true")
            .when(one_in(16, "no flag"), None)
            .otherwise(F.col("out_of_stock")),
        }
    )
    # a few listings twice
    return raw.unionByName(raw.where(one_in(50, "twice")))


@pytest.fixture(scope="module")
def messy(spark, duck, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "listings")
    _disturbed(spark).write.parquet(path)
    duck.execute(f"CREATE OR REPLACE VIEW messy AS SELECT * FROM '{path}/*.parquet'")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "raw_listings", lambda session, folder: session.read.parquet(path))
        yield "messy"


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, messy, name):
    df = CATALOG[name](spark, messy)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    assert oracle.RAW in oracle.ORACLE[name]
    result = duck.execute(oracle.ORACLE[name].replace(oracle.RAW, "raw AS (SELECT * FROM messy)"))
    order = [d[0] for d in result.description]
    want = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    assert _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", list(oracle.ORDER))
def test_order(spark, duck, messy, name):
    df = CATALOG[name](spark, messy)
    columns = oracle.SORTED_BY.get(name, df.columns)
    if not {"s08_preview", "c04_preview", "c25_clean_preview"} & {name}:  # some keys are there twice
        got = [tuple(row[c] for c in columns) for row in df.collect()]
        sql = oracle.ORACLE[name].replace(oracle.RAW, "raw AS (SELECT * FROM messy)")
        assert got == ordered(duck, name, columns, sql)


@pytest.fixture(scope="module")
def written(spark, messy, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("marts"))
    return marts.write_marts(tables.dashboard(spark, messy), folder)


def test_every_mart_has_sql(written):
    assert written.keys() == oracle.MART_QUERIES.keys()


@pytest.mark.parametrize("mart", list(oracle.MART_QUERIES))
def test_written_marts_match_sql(spark, duck, written, mart):
    df = _doubles(spark.read.parquet(written[mart]))
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    sql = oracle.ORACLE[oracle.MART_QUERIES[mart]].replace(oracle.RAW, "raw AS (SELECT * FROM messy)")
    result = duck.execute(sql)
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert _sorted(got) == _sorted([tuple(row[order.index(c)] for c in columns) for row in result.fetchall()])


def test_reports_from_the_cube_equal_those_from_listings(spark, messy):
    clean, dashboard = tables.clean(spark, messy), tables.dashboard(spark, messy)
    cube, dashboard_cube = materialize(stock_cube(clean), "cube"), materialize(stock_cube(dashboard), "cube")
    summaries = {**reports.EXPLORATION, **reports.BUSINESS, **reports.FINDINGS}
    for name, operator in summaries.items():
        if name not in reports.FROM_LISTINGS:
            assert operator(cube).collect() == operator(clean).collect(), name
    for name, build in marts.CUBE_MARTS.items():
        assert build(dashboard_cube).collect() == build(dashboard).collect(), name
