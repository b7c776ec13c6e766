"""Exact medians without holding or shuffling a group's values.

A built-in exact percentile keeps every distinct value of a group in one buffer. Here a first
pass counts rows per slice of 4,096 neighbouring values, which are few, so that almost nothing
is left to shuffle after each task has combined its own. From those counts follow the slices
that hold the two middle ranks; a second pass counts the values inside just these. A hot group
or value weighs no more than any other in either pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.operators.lookup import BROADCAST_BYTES, is_small
from shelfscan.sources.workspace import materialize

SLICE_BITS = 12
FILTER_BITS_PER_SLICE = 16
MIN_FILTER_WORDS, MAX_FILTER_WORDS = 1 << 10, 1 << 18  # of 64 bits; at most some 4 MB to broadcast


def _middle_slices(coded: DataFrame, keys: list[str]) -> DataFrame:
    """The one or two slices of each group that hold its middle ranks, with group figures.

    A group without any value has the one slice of its NULLs.
    """
    group = Window.partitionBy(*keys)
    start = F.shiftleft("slice", SLICE_BITS)
    local = F.col("code") - start
    return (
        coded.groupBy(*keys, "slice")
        .agg(
            F.count("code").alias("slice_n"),
            F.min("code").alias("slice_min"),
            F.max("code").alias("slice_max"),
            F.sum(local).alias("first_moment"),
            F.sum((local * local).cast("decimal(19,0)")).alias("second_moment"),
        )
        .withColumn("slice_sum", F.col("first_moment") + start.cast("decimal(19,0)") * F.col("slice_n"))
        .withColumns(
            {
                "before": F.sum("slice_n").over(group.orderBy(F.asc_nulls_first("slice"))) - F.col("slice_n"),
                "n": F.sum("slice_n").over(group),
                "min_code": F.min("slice_min").over(group),
                "max_code": F.max("slice_max").over(group),
                "sum_code": F.sum("slice_sum").over(group),
            }
        )
        # distances to a whole number next to the mean, summed as decimals and converted once
        .withColumn("centre", F.expr("CASE WHEN n > 0 THEN CAST(sum_code div n AS BIGINT) END"))
        .withColumn("offset", (start - F.col("centre")).cast("decimal(18,0)"))
        .withColumn(
            "around_centre",
            F.sum(
                F.col("second_moment")
                + 2 * F.col("offset") * F.col("first_moment")
                + F.col("offset") * F.col("offset") * F.col("slice_n")
            ).over(group),
        )
        .withColumn("rest", (F.col("sum_code") - F.col("centre").cast("decimal(18,0)") * F.col("n")).cast("double"))
        .withColumn("squares", F.col("around_centre").cast("double") - F.col("rest") * F.col("rest") / F.col("n"))
        .withColumns({"low_rank": F.expr("(n - 1) div 2"), "high_rank": F.expr("n div 2")})
        .where("n = 0 OR (before <= high_rank AND before + slice_n > low_rank)")
        .select(
            *keys, "slice", "before", "low_rank", "high_rank", "n", "min_code", "max_code", "sum_code", "squares"
        )
    )


def summarise(df: DataFrame, keys: list[str], code: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per group: ``n, min_code, max_code, sum_code, squares`` and the two middle values.

    ``code`` is a whole number per row; NULLs do not count, and a group of only NULLs has n = 0
    and NULL figures. ``lower`` and ``upper`` are the values at ranks (n-1)/2 and n/2 counted
    from 0; they are the same row when n is odd. Their mean is the interpolated median; ``upper`` alone is the element at
    position floor(n/2). ``squares`` is the sum of squared distances to the mean.

    The middle slices are written and measured. Within ``broadcast_bytes`` they are broadcast,
    and only rows inside them are counted by value. With too many groups for that, a bitmap of
    their hashes is broadcast, of a size that is bounded: rows outside the slices stay where they
    are but for those whose hash falls on a bit by chance, which the join then drops.

    Calling this runs jobs: the slices are stored and measured before the result is built.
    """
    coded = df.select(*keys, code.alias("code")).withColumn("slice", F.shiftright("code", SLICE_BITS))
    slices = materialize(_middle_slices(coded, keys), "slices")
    small = is_small(slices, keys, broadcast_bytes)
    coded = coded.where("code IS NOT NULL")
    if small:
        wanted = F.broadcast(slices.select(*keys, "slice").alias("s"))
        coded = coded.alias("c").join(wanted, _same([*keys, "slice"]), "left_semi")
    else:
        coded = _maybe_inside(coded, slices, keys)
    counts = coded.groupBy(*keys, "slice", "code").agg(F.count("*").alias("code_n"))

    inside = Window.partitionBy(*keys, "slice").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    figures = F.broadcast(slices.alias("s")) if small else slices.alias("s").hint("merge")
    located = (
        counts.alias("c")
        .join(figures, _same([*keys, "slice"]))
        .select("s.*", "c.code", "c.code_n")
        .withColumn("upto", F.col("before") + F.sum("code_n").over(inside))
    )
    carried = ["n", "min_code", "max_code", "sum_code", "squares"]
    found = located.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        F.min(F.when(F.col("upto") > F.col("low_rank"), F.col("code"))).alias("lower"),
        F.min(F.when(F.col("upto") > F.col("high_rank"), F.col("code"))).alias("upper"),
    )
    without_values = slices.where("n = 0").select(*keys, *carried)
    return found.unionByName(without_values, allowMissingColumns=True)


def _maybe_inside(coded: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (keys, slice) may be among the stored ``slices``: all that are, and few others.

    The filter is a bitmap of FILTER_BITS_PER_SLICE bits for each slice, up to MAX_FILTER_WORDS
    words; beyond that more rows pass, and the result is the same.
    """
    words, wanted = MIN_FILTER_WORDS, slices.count() * FILTER_BITS_PER_SLICE
    while words * 64 < wanted and words < MAX_FILTER_WORDS:
        words *= 2
    hashed = F.xxhash64(*keys, "slice")
    word = F.pmod(hashed, F.lit(words)).alias("word")
    bit = F.pmod(F.shiftright(hashed, 32), F.lit(64)).cast("int").alias("bit")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    bitmap = slices.select(word, bit).groupBy("word").agg(F.bit_or(one).alias("bits"))
    return (
        coded.select("*", word, bit)
        .join(F.broadcast(bitmap), "word")  # at most MAX_FILTER_WORDS rows of two numbers
        .where(F.call_function("bit_get", F.col("bits"), F.col("bit")) == 1)
        .drop("word", "bit", "bits")
    )


def _same(columns: list[str]) -> Column:
    """Rows ``c`` and ``s`` agree in ``columns``; NULL agrees with NULL."""
    return reduce(lambda a, b: a & b, [F.col(f"c.{name}").eqNullSafe(F.col(f"s.{name}")) for name in columns])
