"""Listings derived from line items and parts, against the definitions of FIXTURES.md in whole numbers of any size."""

from __future__ import annotations

import math

import pytest

from shelfscan.sources.driver_tables import SMALL_KEYS, raw_listings

TOP = 2**63 - 1
# line items as (part, supplier, price, quantity); every part is there
ITEMS = [
    (p + i, s + i, 1000.25 + 37 * i, 3.0 + i)
    for p, s in ((0, 0), (7, 5), (10**9, 3), (SMALL_KEYS - 9, SMALL_KEYS - 9), (10**17, 10**17), (10**18, 1), (5, TOP - 20), (TOP - 20, TOP - 20))
    for i in range(20)
]
NEGATIVE = [(-3, 2, 1000.0, 1.0), (4, -90, 1000.0, 1.0), (-TOP, TOP - 3, 1000.0, 1.0), (TOP, -TOP, 1000.0, 1.0), (-TOP, -TOP, 1000.0, 1.0)]


def _rest(value: int, divisor: int) -> int:
    """The remainder with the sign of ``value``."""
    return int(math.copysign(1, value)) * (abs(value) % divisor)


def _listing(p: int, s: int, price: float, quantity: float) -> tuple:
    m = 1000 + round(price * 100) % 199001
    place = _rest(31 * p + 37 * s, 100)
    d = 35 + _rest(13 * p + 7 * s, 36) if place < 15 else 0 if place < 20 else 1 + _rest(13 * p + 7 * s, 35)
    zero, neg = _rest(7 * p + 3 * s, 100) == 9, _rest(3 * p + 11 * s, 200) == 7
    oos = _rest(17 * p + 29 * s, 100) < 12 + d / 2 + 35
    discount = -(1 + _rest(p, 10)) if neg else d if _rest(5 * p + s, 20) else None
    selling = 0 if zero else m + 100 if neg else m * (100 - d) // 100
    weight = None if _rest(p + 7 * s, 20) == 3 else 300
    return 0 if zero else m, discount, selling, weight, 0 if oos else 1 + int(quantity) % 200, str(oos)


def _tables(spark, folder, items, kind):
    """Both tables with keys of one type; the size tells a listing's part."""
    lines = spark.createDataFrame(items, "l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double")
    lines = lines.selectExpr(f"cast(l_partkey AS {kind}) l_partkey", f"cast(l_suppkey AS {kind}) l_suppkey", "l_extendedprice", "l_quantity")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    parts = lines.where("l_partkey IS NOT NULL").selectExpr("l_partkey AS p_partkey").distinct()
    parts.selectExpr("p_partkey", "cast(p_partkey AS string) AS p_name", "'PROMO' AS p_type", "5 AS p_size").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def _found(spark, folder):
    columns = ["mrp", "discount_percent", "discounted_selling_price", "weight_in_gms", "available_quantity", "out_of_stock"]
    return sorted(((r[0], tuple(r)[1:]) for r in raw_listings(spark, folder).select("name", *columns).collect()), key=repr)


@pytest.mark.parametrize("items", [ITEMS, NEGATIVE])
def test_any_bigint_is_a_key(spark, tmp_path, items):
    expected = sorted(((str(item[0]), _listing(*item)) for item in items), key=repr)
    assert _found(spark, _tables(spark, tmp_path, items, "bigint")) == expected


def test_narrow_keys_are_taken_as_bigint(spark, tmp_path):
    items = [(p, s, 1000.25, 3.0) for p, s in ((2**31 - 1, 2**31 - 2), (2 * 10**9, 5), (70_000_000, 9))]
    expected = sorted(((str(item[0]), _listing(*item)) for item in items), key=repr)
    assert _found(spark, _tables(spark, tmp_path, items, "int")) == expected


def test_without_a_key(spark, tmp_path):
    """Lines without a part have no listing; those without a supplier have one, without an id."""
    folder = _tables(spark, tmp_path, [(None, 1, 1000.0, 1.0), (1, None, 1000.0, 1.0), (10**18, None, 1000.0, 1.0)], "bigint")
    assert [(r["sku_id"], r["mrp"]) for r in raw_listings(spark, folder).collect()] == [(None, 101000)] * 2
