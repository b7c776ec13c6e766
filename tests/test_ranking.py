from __future__ import annotations

import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import ranking
from shelfscan.operators.insights import pareto


def _brute_force(rows, wanted):
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    out, above = [], {}
    for key, value in ordered:
        above.setdefault(value, sum(v for _, v in rows if v >= value))
    for rank, (key, value) in enumerate(ordered[:wanted], 1):
        out.append((key, rank, above[value]))
    return out


def _rows(kind):
    rng = random.Random(5)
    values = {
        "spread": [Decimal(rng.randrange(1, 10**6)) / 100 for _ in range(900)],
        "ties": [Decimal(rng.randrange(1, 12)) for _ in range(900)],
        # a third of all rows share one value, which spans several range partitions
        "hot": [Decimal(500)] * 300 + [Decimal(rng.randrange(1, 1000)) for _ in range(600)],
        "same": [Decimal(3)] * 400,
    }[kind]
    return [(f"k{i:05d}", v) for i, v in enumerate(values)]


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "same"])
@pytest.mark.parametrize("share", [0.2, 0.6, 1.0])
def test_against_sorting(spark, kind, share, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 60)
    monkeypatch.setattr(ranking, "SAMPLES_PER_RANGE", 5)
    rows = _rows(kind)
    wanted = math.ceil(len(rows) * share)
    df = spark.createDataFrame(rows, "key string, value decimal(12,2)").repartition(5)
    result = ranking.ranked_with_running_total(df, ranking.value_slices(df, "value"), "value", "key", wanted).collect()
    assert [(r["key"], r["rank"], r["running_total"]) for r in result] == _brute_force(rows, wanted)


def test_slices_keep_the_order_of_values(spark):
    codes = sorted({0, 1, 2047, 2048, 2049, *(3**k for k in range(39)), *(2**k - 1 for k in range(63)), 10**18})
    df = spark.createDataFrame([(c,) for c in codes], "code bigint")
    slices = [r[0] for r in df.orderBy("code").select(ranking._slice(F.col("code"))).collect()]
    assert slices == sorted(slices) and max(slices) < 60_000
    assert slices[: codes.index(2048)] == [c for c in codes if c < 2048]


def test_a_short_list_reads_few_rows(spark):
    df = spark.range(1, 100_001).select(F.col("id").cast("string").alias("k"), F.col("id").cast("decimal(12,2)").alias("v"))
    cut = ranking.cut_value(ranking.value_slices(df, "v"), 20)
    assert df.where(F.col("v") >= F.lit(cut)).count() < 300


@pytest.fixture(scope="module")
def many(spark):
    """60,000 listings, a third of which earn the same."""
    return spark.range(60_000).select(
        F.format_string("S%06d", F.col("id")).alias("sku_id"),
        F.lit("n").alias("name"),
        F.lit("c").alias("category"),
        F.when(F.col("id") % 3 == 0, F.lit(900)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("decimal(12,2)").alias("estimated_revenue"),
    ).repartition(7)


def test_any_limit_gives_the_head_of_the_whole_curve(spark, many, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 3000)
    earning = [(r["sku_id"], r["estimated_revenue"]) for r in many.where("estimated_revenue > 0").collect()]
    total, n = sum(v for _, v in earning), len(earning)
    above: dict = {}
    for _, value in earning:
        above[value] = above.get(value, 0) + value
    reached, running = 0, {}
    for value in sorted(above, reverse=True):
        reached += above[value]
        running[value] = reached
    ordered = sorted(earning, key=lambda r: (-r[1], r[0]))
    half_up = lambda q, places: q.quantize(Decimal(places), ROUND_HALF_UP)
    expected = [
        (float(half_up(Decimal(100 * rank) / n, "1")), value, float(half_up(running[value] * 100 / total, "0.1")))
        for rank, (_, value) in enumerate(ordered, 1)
    ]
    for share, limit in [(0.2, 1), (0.2, 20), (0.2, 10_001), (0.2, None), (1.0, 10_001), (1.0, None)]:
        got = pareto(many, share, limit).collect()
        size = min(math.ceil(n * Decimal(str(share))), limit or n)
        assert [(r["product_percentile"], r["revenue"], r["cumulative_revenue_pct"]) for r in got] == expected[:size]


def test_one_exchange_of_rows(spark, many, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 3000)
    df = pareto(many, limit=None)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = re.findall(r"Exchange (?!SinglePartition)(\w+)\(([^,]*)", final)
    assert [kind for kind, _ in exchanges if kind == "rangepartitioning"] == ["rangepartitioning"]
    # the other exchanges are of one row per range
    assert all("HashAggregate" in final[final.index(f"{kind}({what}") :].split("\n")[1] or "Join" in final for kind, what in exchanges[1:])


def test_pareto_head_equals_the_head_of_the_whole_curve(spark):
    rows = [(f"k{i:04d}", "n", "c", Decimal(i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "sku_id string, name string, category string, estimated_revenue decimal(12,2)")
    whole = pareto(df, limit=None).collect()
    assert len(whole) == math.ceil(390 * 0.2)
    assert pareto(df, limit=20).collect() == whole[:20]
    assert pareto(df.where("estimated_revenue < 0")).collect() == []
    # a limit beyond the top share still returns the whole share
    assert pareto(df, limit=1000).collect() == whole
