"""Top lists that read few files, against sorting everything."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import cleaning, marts
from shelfscan.plans import tables
from shelfscan.sources import clustered
from tests.conftest import DATA


@pytest.fixture(scope="module")
def listings(spark):
    df = tables.dashboard(spark, DATA)
    odd = df.limit(40).withColumns({"category": F.lit(None).cast("string"), "sku_id": F.concat(F.lit("N"), "sku_id")})
    hot = df.limit(300).withColumns({"category": F.lit("one value"), "estimated_revenue": F.lit(5).cast("decimal(12,2)"), "sku_id": F.concat(F.lit("H"), "sku_id")})
    none = df.limit(30).withColumns({"category": F.lit("no value"), "estimated_revenue": F.lit(None).cast("decimal(12,2)"), "sku_id": F.concat(F.lit("V"), "sku_id")})
    return df.union(odd).union(hot).union(none)


@pytest.fixture(scope="module")
def path(listings, tmp_path_factory):
    return clustered.write(listings, str(tmp_path_factory.mktemp("c") / "t"), "category", "estimated_revenue", files=60)


@pytest.mark.parametrize("n", [1, 10, 200, 100_000])
def test_lists_of_each_category(spark, listings, path, n):
    names = [r[0] for r in listings.select("category").distinct().collect()]
    assert None in names and "one value" in names
    for name in [*names, "no such category", ""]:
        want = marts.top_products(listings.where(F.col("category").eqNullSafe(F.lit(name))), n).collect()
        found = clustered.candidates(spark, path, "category", n, name)
        assert marts.top_products(found, n).collect() == want


def test_few_files_are_read(spark, listings, path):
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert every >= 50
    for name in [r[0] for r in tables.dashboard(spark, DATA).select("category").distinct().collect()]:
        assert len(clustered.candidates(spark, path, "category", 10, name).inputFiles()) <= 3
    top = clustered.candidates(spark, path, "category", 10, everything=True)
    assert len(top.inputFiles()) <= 12 < every  # one or two of each category
    assert marts.top_products(top).collect() == marts.top_products(listings).collect()


def test_replaced_and_empty(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    df = cleaning.clean_for_dashboard(raw({"category": "a"}, {"category": "b"}))
    clustered.write(df, path, "category", "estimated_revenue")
    clustered.write(df.where("category = 'a'"), path, "category", "estimated_revenue")
    assert clustered.candidates(spark, path, "category", 5, "b").count() == 0
    assert clustered.candidates(spark, path, "category", 5, "a").count() == 1
    clustered.write(df.limit(0), path, "category", "estimated_revenue")
    assert clustered.candidates(spark, path, "category", 5, everything=True).count() == 0
