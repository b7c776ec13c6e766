from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfscan.operators.lookup import BROADCAST_BYTES
from shelfscan.operators import median
from shelfscan.operators.median import summarise
from shelfscan.sources.workspace import materialize


def _brute_force(rows):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
        else:
            groups.setdefault(key, [])
    return {
        k: (len(v), min(v), max(v), sum(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]) if v else (0, *[None] * 5)
        for k, v in groups.items()
    }


@pytest.mark.parametrize("limit", [0, BROADCAST_BYTES])
def test_against_sorting(spark, limit):
    rng = random.Random(3)
    rows = []
    for key, size, spread in [("a", 501, 50), ("b", 400, 10**9), (None, 7, 10**6), ("one", 1, 5), ("two", 2, 10**6)]:
        rows += [(key, rng.randrange(-spread, spread)) for _ in range(size)]
    rows += [("a", None), ("empty", None)]
    # a hot value that holds most of a group, and a pair around a slice edge
    rows += [("hot", 77)] * 2000 + [("hot", v) for v in range(1000)]
    rows += [("edge", 4095), ("edge", 4096)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    result = summarise(df, ["k"], F.col("v"), limit).collect()
    got = {r["k"]: (r["n"], r["min_code"], r["max_code"], r["sum_code"], r["lower"], r["upper"]) for r in result}
    assert got == _brute_force(rows)


def test_deviation_does_not_lose_digits(spark):
    # far from zero and close together: a plain sum of squares would cancel to nothing
    values = [10**12 + v for v in (1, 2, 3, 4, 100, 5000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("k", F.lit(1))
    row = summarise(df, ["k"], F.col("v")).first()
    assert math.sqrt(row["squares"] / (row["n"] - 1)) == pytest.approx(statistics.stdev(values), rel=1e-6)


def test_values_are_neither_gathered_nor_shuffled_whole(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    result = summarise(df, ["k"], F.col("v"))
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    # rows are filtered to the middle slices and combined before the first exchange
    final = plan[: plan.index("Initial Plan")]
    assert "LeftSemi" in final[final.index("partial_count") :]


def test_deviation_is_the_same_for_any_partitions(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**10)) + 10**11).alias("v"))
    found = [summarise(df.repartition(n), ["k"], F.col("v")).first()["squares"] for n in (1, 64)]
    assert found[0] == found[1]
    values = [r["v"] for r in df.collect()]
    n, total = len(values), sum(values)
    exact = (n * sum(v * v for v in values) - total * total) / n
    assert found[0] == pytest.approx(exact, rel=1e-12)


def test_a_bitmap_keeps_most_values_in_place(spark):
    """With too many groups for a broadcast, values outside the middle slices don't reach the exchange either."""
    df = spark.range(400_000).select((F.col("id") % 40).alias("k"), F.xxhash64("id").alias("v"))
    df = df.withColumn("v", F.pmod("v", F.lit(10**9)))
    coded = df.select("k", F.col("v").alias("code")).withColumn("slice", F.shiftright("code", median.SLICE_BITS))
    slices = materialize(median._middle_slices(coded, ["k"]), "slices")
    inside = coded.join(slices, ["k", "slice"], "left_semi").count()
    passed = median._maybe_inside(coded, slices, ["k"])
    assert inside <= passed.count() <= inside + 400_000 // 100
    assert passed.columns == coded.columns
    assert passed.join(slices, ["k", "slice"], "left_semi").count() == inside
    key = lambda r: r["k"]
    small, large = summarise(df, ["k"], F.col("v")), summarise(df, ["k"], F.col("v"), 0)
    assert sorted(small.collect(), key=key) == sorted(large.collect(), key=key)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(median, "MIN_FILTER_WORDS", 1)
    monkeypatch.setattr(median, "MAX_FILTER_WORDS", 1)
    rows = [(f"k{i % 97}", i * i % 10_007 * 4096) for i in range(5000)] + [(None, 5), (None, None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {r["k"]: (r["n"], r["min_code"], r["max_code"], r["sum_code"], r["lower"], r["upper"]) for r in summarise(df, ["k"], F.col("v"), 0).collect()}
    assert got == _brute_force(rows)
