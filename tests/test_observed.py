"""Figures gathered while a table is written, and distinct counts from sketches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import cleaning, cube, quality
from shelfscan.plans import reports, tables
from shelfscan.sources import sinks
from shelfscan.sources.workspace import materialize
from tests.conftest import DATA


def _summaries(group):
    return {name: report for name, report in group.items() if isinstance(report, quality.Summary)}


def _jobs(spark, group: str, work) -> int:
    spark.sparkContext.setJobGroup(group, group)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("group", ["AUDIT", "VALIDATION"])
def test_equal_to_the_reports_and_without_a_scan(spark, tmp_path, group):
    raw = tables.raw(spark, DATA)
    df = raw if group == "AUDIT" else cleaning.clean(raw)
    summaries = _summaries(getattr(reports, group))
    assert len(summaries) >= 5
    found = {}

    def observed():
        found["path"], found["reports"] = quality.summarise_while(df, summaries, lambda x: sinks.write_table(x, str(tmp_path / "o")))
        found["rows"] = {name: report.collect() for name, report in found["reports"].items()}

    plain = _jobs(spark, f"plain {group}", lambda: sinks.write_table(df, str(tmp_path / "p")))
    # the same jobs as for a write alone; those that fetch the rows of figures read no table
    assert _jobs(spark, f"observed {group}", observed) <= plain + len(summaries)
    for report in found["reports"].values():
        assert report.inputFiles() == []
    stored = spark.read.parquet(found["path"])
    assert found["rows"] == {name: report(stored).collect() for name, report in summaries.items()}


def test_observed_after_an_exchange(spark, raw, tmp_path):
    """Figures are those of the rows written, however the frame is computed."""
    df = raw(*[{"mrp": m} for m in (0, 5, None, 7, 0)]).repartition(3).orderBy("mrp")
    summaries = {"n": quality.row_count(), "zero": quality.unpriced_count()}
    _, found = quality.summarise_while(df, summaries, lambda x: sinks.write_table(x, str(tmp_path / "t")))
    assert found["n"].first()[0] == 5 and found["zero"].first()[0] == 2


def test_observed_empty_table(spark, raw, tmp_path):
    df = raw({}).where("mrp < 0")
    _, found = quality.summarise_while(df, _summaries(reports.AUDIT), lambda x: sinks.write_table(x, str(tmp_path / "t")))
    for name, report in found.items():
        assert report.collect() == reports.AUDIT[name](df).collect(), name


def test_category_counts_answer_both_reports(spark, raw):
    df = raw({}, {"category": None, "weight_in_gms": None}, {"mrp": 0}, {"category": "B", "discount_percent": -1}, {"discount_percent": None})
    counts = materialize(quality.category_counts(df), "counts")
    for name in reports.FROM_CATEGORY_COUNTS:
        assert reports.AUDIT[name](counts).collect() == reports.AUDIT[name](df).collect()


def test_distinct_names_from_sketches(spark):
    df = spark.range(60_000).select(
        F.concat(F.lit("name "), (F.col("id") % 20_000).cast("string")).alias("name"),
        (F.col("id") % 3).cast("string").alias("category"),
        (F.col("id") % 100).cast("int").alias("discount_percent"),
        (F.col("id") % 2 == 0).alias("out_of_stock"),
        F.lit(100).alias("weight_in_gms"),
        F.lit(1).alias("available_quantity"),
        *[F.lit(1).cast("decimal(10,2)").alias(c) for c in ("mrp", "discounted_selling_price", "price_per_gram", "estimated_revenue")],
    )
    cells = materialize(cube.stock_cube(df, sketch_names=True), "cube")
    for by in ([], ["category"], ["out_of_stock"], ["category", "discount_percent"]):
        exact = {tuple(r)[:-1]: r["unique_products"] for r in cube.distinct_names(df, by).collect()}
        for rolled in (cells, cube.stock_cube(cells)):
            near = {tuple(r)[:-1]: r["unique_products"] for r in cube.distinct_names(rolled, by).collect()}
            assert near.keys() == exact.keys()
            assert all(abs(near[k] - exact[k]) <= max(1, 0.06 * exact[k]) for k in exact)
    with pytest.raises(ValueError, match="sketches"):
        cube.distinct_names(cube.stock_cube(df), [])


def test_names_that_are_null(spark):
    df = tables.clean(spark, DATA).withColumn("name", F.lit(None).cast("string"))
    cells = cube.stock_cube(df, sketch_names=True)
    assert cube.distinct_names(cells, []).first()[0] == cube.distinct_names(df, []).first()[0] == 0
