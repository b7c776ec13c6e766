from __future__ import annotations

from decimal import Decimal

import pytest

from shelfscan.operators import cleaning, explore, insights, lookup, measures, quality
from tests.conftest import column


def test_median_rounds_half_to_even(raw):
    df = raw(
        *[{"category": "x", "weight_in_gms": w} for w in (2, 3, None)],
        *[{"category": "y", "weight_in_gms": w} for w in (3, 4, None)],
        {"category": "z", "weight_in_gms": None},
        {"category": None, "weight_in_gms": None},
    )
    assert column(cleaning.fill_weights(df), "weight_in_gms") == [2, 3, 2, 3, 4, 4, None, None]
    upper = cleaning.fill_weights(df, mode="upper", fallback=500)
    assert column(upper, "weight_in_gms") == [2, 3, 3, 3, 4, 4, 500, 500]


def test_zero_median_counts_as_unknown_only_with_a_fallback(raw):
    df = raw({"weight_in_gms": 0}, {"weight_in_gms": 0}, {"weight_in_gms": None})
    assert column(cleaning.fill_weights(df), "weight_in_gms") == [0, 0, 0]
    assert column(cleaning.fill_weights(df, "upper", 500), "weight_in_gms") == [0, 0, 500]


def test_median_sees_unpriced_rows_only_in_the_default_order(raw):
    df = raw({"mrp": 0, "weight_in_gms": 10}, {"weight_in_gms": 50}, {"weight_in_gms": 50}, {"weight_in_gms": None},
             {"mrp": 0, "weight_in_gms": 10}, {"mrp": 0, "weight_in_gms": 10})
    assert column(cleaning.clean(df), "weight_in_gms") == [50, 50, 10]
    assert column(cleaning.clean_for_dashboard(df), "weight_in_gms") == [50, 50, 50]


def test_prices(raw):
    df = raw({"mrp": None}, {"mrp": 0}, {"mrp": 12345, "discounted_selling_price": None}, {"mrp": 100})
    assert column(cleaning.drop_unpriced(df), "mrp") == [None, 12345, 100]
    assert column(cleaning.drop_unpriced(df, drop_null=True), "mrp") == [12345, 100]
    assert column(cleaning.to_major_units(df), "mrp") == [None, Decimal("0.00"), Decimal("123.45"), Decimal("1.00")]
    # the dashboard counts a missing selling price as 0
    assert column(cleaning.clean_for_dashboard(df), "discounted_selling_price")[0] == Decimal("0.00")


def test_discounts(raw):
    df = raw(
        {"discount_percent": None, "discounted_selling_price": 800},
        {"discount_percent": -5, "discounted_selling_price": 1050},
        {"discount_percent": 0},
    )
    fixed = cleaning.fix_negative_discounts(cleaning.fill_discounts(df))
    assert column(fixed, "discount_percent") == [0, 0, 0]
    assert column(fixed, "discounted_selling_price") == [800, 1000, 900]
    light = cleaning.clean_light(df)
    assert column(light, "discount_percent") == [0, -5, 0]


def test_flags(raw):
    df = raw(*[{"out_of_stock": v} for v in ("True", "False", "true", "", None)])
    assert column(cleaning.flag_to_boolean(df), "out_of_stock") == [True, False, False, False, False]


def test_derived_columns(raw):
    df = raw(
        {"discounted_selling_price": 1000, "weight_in_gms": 3, "available_quantity": 7},
        {"weight_in_gms": 0},
        {"weight_in_gms": -4},
        {"discounted_selling_price": 1, "weight_in_gms": 200},
    )
    clean = cleaning.clean(df)
    assert column(clean, "price_per_gram") == [Decimal("3.3333"), None, None, Decimal("0.0001")]
    assert column(clean, "estimated_revenue")[0] == Decimal("70.00")
    assert column(cleaning.clean_for_dashboard(df), "price_per_gram")[1:3] == [Decimal("0.0000")] * 2


def test_cleaning_twice_from_the_same_raw_table(raw):
    df = raw({"discount_percent": -1}, {"weight_in_gms": None}, {"mrp": 0})
    assert cleaning.clean(df).orderBy("sku_id").collect() == cleaning.clean(df).orderBy("sku_id").collect()


def test_large_category_tables_are_not_broadcast(spark, raw):
    rows = [{"category": "hot", "weight_in_gms": i if i % 4 else None} for i in range(200)]
    rows += [{"category": f"c{i % 40}", "weight_in_gms": i if i % 3 else None} for i in range(400)]
    rows += [{"category": None, "weight_in_gms": None}, {"category": "none known", "weight_in_gms": None}]
    df = raw(*rows)
    small = cleaning.fill_weights(df)
    large = cleaning.fill_weights(df, broadcast_bytes=0)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert large.count() == len(rows)
    assert small.orderBy("sku_id", "category").collect() == large.orderBy("sku_id", "category").collect()


def test_report_counts_what_the_steps_touch(raw):
    df = raw(
        {"discount_percent": None},
        {"weight_in_gms": None},
        {"category": "unknown weights", "weight_in_gms": None},
        {"mrp": 0, "discount_percent": -3},
        {"discount_percent": -3},
        {"mrp": None},
    )
    rows = {r["step"]: r["rows_affected"] for r in quality.cleaning_report(df).collect()}
    assert rows == {"4a": 1, "4b": 1, "5a": 1, "5b": 1, "6": 5, "7": 5, "8": 5, "9": 5}


def test_duplicate_keys(raw):
    df = raw({"sku_id": "a"}, {"sku_id": "a"}, {"sku_id": "b"})
    assert quality.duplicate_keys(df).collect() == [("a", 2)]


def test_category_without_stock_has_no_lost_revenue(raw):
    df = cleaning.clean(
        raw(
            {"category": "gone", "out_of_stock": "True", "available_quantity": 0},
            {"category": "mixed", "out_of_stock": "True", "available_quantity": 0},
            {"category": "mixed"},
            {"category": "full"},
        )
    )
    assert [r["category"] for r in insights.lost_revenue(df).collect()] == ["mixed"]
    assert [r["category"] for r in insights.revenue_retention(df).collect()] == ["full", "mixed"]


def test_best_value_breaks_ties_by_key(raw):
    df = cleaning.clean(raw(*[{"name": f"n{i}", "weight_in_gms": 100} for i in range(6)]))
    assert [r["name"] for r in insights.best_value(df).collect()] == ["n0", "n1", "n2"]


@pytest.mark.parametrize("limit", [0, lookup.BROADCAST_BYTES])
def test_lookup_keeps_every_row(raw, spark, limit):
    df = raw(*[{"category": c} for c in ("a", "b", None)])
    table = spark.createDataFrame([("a", 1)], "category string, v int")
    joined = lookup.attach(df, table, "category", df.weight_in_gms.isNotNull(), broadcast_bytes=limit)
    assert column(joined, "v") == [1, None, None]


def test_groups_without_values_stay(raw):
    df = cleaning.clean(raw({"category": "a"}, {"category": "b", "discounted_selling_price": None}))
    ranges = {r["category"]: r["median_price"] for r in insights.price_range(df).collect()}
    assert ranges == {"a": 9.0, "b": None}
    nothing = explore.summary_statistics(df.where("mrp < 0")).collect()
    assert [(r["count"], r["median_val"], r["std_dev"]) for r in nothing] == [(0, None, None)] * 3
    single = explore.summary_statistics(df.where("category = 'a'")).collect()
    assert [(r["count"], r["mean_val"], r["std_dev"]) for r in single] == [(1, 10.0, None), (1, 9.0, None), (1, 10.0, None)]


def test_price_per_gram_of_a_negative_price(raw):
    df = cleaning.typed(raw({"discounted_selling_price": -100, "weight_in_gms": 300}, {"discounted_selling_price": 100, "weight_in_gms": 300},
                            {"discounted_selling_price": -1, "weight_in_gms": 200}, {"discounted_selling_price": -1, "weight_in_gms": 201}))
    assert [str(v) for v in column(cleaning.add_price_per_gram(df), "price_per_gram")] == ["-0.0033", "0.0033", "-0.0001", "0.0000"]


def test_chart_tables_read_raw_rows(raw):
    df = cleaning.typed(raw({"discount_percent": None}, {"mrp": 0, "discounted_selling_price": 0}, {"out_of_stock": "True", "available_quantity": 7}))
    assert sorted((r["bin_start"] is None, r["skus"]) for r in measures.discount_bins(df).collect()) == [(False, 2), (True, 1)]
    row = measures.by_category(df).first()
    assert (row["estimated_revenue"], row["out_of_stock_rate"]) == (45.0, 1 / 3)
