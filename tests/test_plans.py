"""Physical plans keep their shape: what is pruned, pushed, reused and never gathered."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import insights
from shelfscan.plans import reports, tables
from shelfscan.plans.catalog import CATALOG
from tests.conftest import DATA

# written or collected before the returned plan, or plain reads of a file
EAGER = re.compile(r"^s0")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df) -> str:
    df.collect()
    return _plan(df)


@pytest.mark.parametrize("name", [n for n in CATALOG if not EAGER.match(n)])
def test_no_cross_joins_or_python(spark, name):
    plan = _plan(CATALOG[name](spark, DATA))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan


def test_rows_are_never_gathered_for_a_window(spark):
    """A one-task exchange may only follow a partial aggregate or a limit."""
    for name in ("e01_summary_statistics", "e02_sku_distribution", "b04_revenue_by_category", "b14_pareto_all"):
        plan = _plan(CATALOG[name](spark, DATA))
        for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate" in below or "Limit" in below, (name, below)


def test_top_lists_do_not_sort_the_table(spark):
    for name in ("b01_top_discounts", "b03_premium_low_discount", "b09_largest_markdowns", "b15_cheap_and_stocked",
                 "d09_top_products", "s08_preview"):
        assert "TakeOrderedAndProject" in _plan(CATALOG[name](spark, DATA))


def test_top_lists_per_category_trim_before_the_shuffle(spark):
    for name in ("b06_best_value", "d13_top_products_by_category"):
        plan = _plan(CATALOG[name](spark, DATA))
        assert plan.count("WindowGroupLimit") == 2


def test_totals_reuse_the_grouping(spark):
    for name in ("e02_sku_distribution", "e03_discount_brackets", "b04_revenue_by_category", "e09_revenue_by_category"):
        assert "ReusedExchange" in _final(CATALOG[name](spark, DATA))


def test_headline_figures_shuffle_names_only(spark):
    df = spark.range(100_000).select(
        F.col("id").cast("string").alias("sku_id"),
        F.concat(F.lit("name "), "id").alias("name"),
        (F.col("id") % 7).cast("string").alias("category"),
        *[F.lit(5).cast(t).alias(c) for c, t in {
            "mrp": "decimal(10,2)", "discount_percent": "int", "available_quantity": "int",
            "price_per_gram": "decimal(10,4)", "estimated_revenue": "decimal(12,2)"}.items()],
        (F.col("id") % 2 == 0).alias("out_of_stock"),
    )
    result = insights.executive_summary(df)
    assert result.first()["unique_products"] == 100_000 and result.first()["total_categories"] == 7
    plan = _plan(result)
    assert "Expand" not in plan and "NestedLoop" not in plan
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+, ", plan)) == {"name", "category"}


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(CATALOG["b19_deep_discounts"](spark, DATA))
    assert "GreaterThan(discount_percent,60)" in plan
    plan = _plan(CATALOG["e05_stock_by_category"](spark, DATA))
    assert re.search(r"ReadSchema: struct<category:string,out_of_stock:boolean>", plan)
    plan = _plan(CATALOG["f3_deep_discount_count"](spark, DATA))
    assert re.search(r"ReadSchema: struct<discount_percent:int>", plan)


def test_tables_are_built_once(spark):
    assert tables.clean(spark, DATA).inputFiles() == tables.clean(spark, DATA).inputFiles()


def test_a_hot_category_is_combined_before_the_shuffle(spark):
    """Grouping by category, whatever its share of the rows, shuffles partial results only."""
    for name, operator in {**reports.EXPLORATION, **reports.BUSINESS}.items():
        for stage in _plan(operator(tables.clean(spark, DATA))).split("Exchange hashpartitioning(category")[1:]:
            before_scan = stage.split("FileScan")[0].split("Exchange")[0]
            assert "HashAggregate" in before_scan or "WindowGroupLimit" in before_scan, name
