from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from shelfscan.functions.bands import DISCOUNT_BRACKETS, band_index, band_label, decade
from shelfscan.functions.exact import mean, pct, ratio


def test_ratio_rounds_the_exact_quotient(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(10**9), rng.randrange(1, 10**6)) for _ in range(300)]
    pairs += [(247, 20), (1, 8), (5, 1000), (-5, 2), (5, -2), (0, 3), (10**24 + 5, 10)]
    rows = [(i, Decimal(a), Decimal(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a decimal(30,0), b decimal(30,0)")
    got = [r[0] for r in df.orderBy("i").select(ratio(F.col("a"), F.col("b"), 1)).collect()]
    want = [
        float((Decimal(a) * 10 / Decimal(b)).quantize(Decimal(1), ROUND_HALF_UP) / 10)
        for a, b in pairs[:-1]
    ]
    assert got[:-1] == want


def test_ratio_of_nothing_is_null(spark):
    assert spark.range(1).select(ratio(F.lit(3), F.lit(0), 1), pct(F.lit(0), F.lit(0))).first() == (None, None)


def test_mean_ignores_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert df.agg(mean(F.col("x"), 0)).first()[0] == 2.0
    assert df.where("x IS NULL").agg(mean(F.col("x"), 0)).first()[0] is None


def test_bracket_edges(spark):
    discounts = [None, -5, 0, 1, 10, 11, 40, 41, 70, 71, 80]
    df = spark.createDataFrame(list(enumerate(discounts)), "i int, d int")
    index = band_index(F.col("d"), DISCOUNT_BRACKETS)
    rows = df.orderBy("i").select(band_label(index, DISCOUNT_BRACKETS), decade(F.col("d"))).collect()
    assert [r[0] for r in rows] == [
        None,
        None,
        "0% (No discount)",
        "1-10%",
        "1-10%",
        "11-20%",
        "31-40%",
        "41-50%",
        "61-70%",
        "70%+",
        "70%+",
    ]
    assert [r[1] for r in rows] == [None, -10, 0, 0, 10, 10, 40, 40, 70, 70, 80]
