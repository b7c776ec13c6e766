"""Global rank and running total of a table's largest values, without a one-task window.

There is one way for any number of wanted rows:

1. Rows are counted by slices of neighbouring values, at most some 54,000 whatever the table.
   From the counts follows the least slice that can hold a wanted row, to a thousandth of its
   value, and the rows from there on are stored.
2. A sample of them gives the borders of ranges over value *and* key, so that a value that a
   third of the rows share is spread over many ranges.
3. One exchange deals the rows out by range, and a window inside each range gives position and
   running total. What lies before a range is added from a table of one row per range. The
   ranges come out in order, so nothing is sorted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.sources.workspace import materialize

_SLICE_BITS = 10  # leading bits of a value below its first that a slice keeps
ROWS_PER_RANGE = 50_000
MAX_RANGES = 4096  # beyond that the ranges grow; a window's rows are sorted on disk if need be
SAMPLES_PER_RANGE = 50


def _code(value: str, scale: int) -> Column:
    """A decimal, not negative, as a whole number of its smallest unit."""
    return (F.col(value) * F.lit(10**scale)).cast("bigint")


def _slice(code: Column) -> Column:
    """A number that grows with the code, equal for codes that share their leading bits."""
    shift = F.greatest(F.length(F.bin(code)) - (_SLICE_BITS + 1), F.lit(0))
    return F.call_function("shiftright", code, shift) + shift * (1 << _SLICE_BITS)


def value_slices(rows: DataFrame, value: str) -> DataFrame:
    """Stored rows (slice, n, amount, least): number and sum of the values in each slice, and the smallest."""
    scale = rows.schema[value].dataType.scale
    return materialize(
        rows.groupBy(_slice(_code(value, scale)).alias("slice")).agg(
            F.count("*").alias("n"), F.sum(value).alias("amount"), F.min(value).alias("least")
        ),
        "slices",
    )


def cut_value(slices: DataFrame, wanted: int):
    """The smallest value of the last slice that is needed for the ``wanted`` largest."""
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    needed = slices.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < wanted)
    return needed.agg(F.min("least")).first()[0]


def _borders(rows: DataFrame, value: str, key: str, count: int) -> list[tuple]:
    """First (value, key) of each range but the first, in order, from a sample by hash of the key.

    The sample has some SAMPLES_PER_RANGE rows for each of at most MAX_RANGES ranges.
    """
    ranges = min(count // ROWS_PER_RANGE + 2, MAX_RANGES)
    one_in = max(1, count // (ranges * SAMPLES_PER_RANGE))
    sampled = rows.where(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0).select(value, key)
    found = [tuple(r) for r in sampled.orderBy(F.desc(value), key).collect()]
    return list(dict.fromkeys(found[i * len(found) // ranges] for i in range(1, ranges))) if found else []


def _range(value: str, key: str, borders: list[tuple], kind: str) -> Column:
    """How many borders are not behind the row: found by halving, not by looking at each."""
    edges = F.array(*[F.struct(F.lit(v).cast(kind).alias("v"), F.lit(k).alias("k")) for v, k in borders])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(borders).bit_length()))])

    def step(t: Column, b: Column) -> Column:
        edge = F.get(edges, t + b - 1)
        behind = (F.col(value) < edge["v"]) | ((F.col(value) == edge["v"]) & (F.col(key) >= edge["k"]))
        return F.when(behind, t + b).otherwise(t)

    return F.aggregate(steps, F.lit(0), step)


def _offsets(ranged: DataFrame, value: str, borders: list[tuple], kind: str) -> DataFrame:
    """One row per range: rows and amount before it, and the totals at the values it shares with its neighbours.

    Only a value that a border lies in can continue in the next range.
    """
    values = F.array(*[F.lit(v).cast(kind) for v, _ in borders])
    head, tail = F.get(values, F.col("range") - 1), F.get(values, F.col("range"))
    sums = (
        ranged.groupBy("range")
        .agg(
            F.count("*").alias("rows"),
            F.sum(value).alias("amount"),
            F.sum(F.when(F.col(value) == head, F.col(value))).alias("head_amount"),
        )
        .withColumns({"head": head, "tail": tail})
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumns(
        {
            "rows_before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)),
            "amount_before": F.coalesce(F.sum("amount").over(earlier), F.lit(0)),
        }
    )
    # the total at a shared value: all up to the last range that begins with it, and its part there
    through = placed.groupBy(F.col("head").alias("shared")).agg(
        F.max(F.col("amount_before") + F.coalesce("head_amount", F.lit(0))).alias("through")
    )
    at_head = through.select(F.col("shared").alias("head"), F.col("through").alias("head_total"))
    at_tail = through.select(F.col("shared").alias("tail"), F.col("through").alias("tail_total"))
    return placed.join(at_head, "head", "left").join(at_tail, "tail", "left").select(
        "range", "rows_before", "amount_before", "head", "head_total", "tail", "tail_total"
    )


def ranked_with_running_total(rows: DataFrame, slices: DataFrame, value: str, key: str, wanted: int) -> DataFrame:
    """The ``wanted`` first rows by ``value`` descending, then ``key``; in that order.

    Adds ``rank`` (from 1) and ``running_total`` (sum of all values not below the row's own, so
    equal values share it). ``slices`` are the ``value_slices`` of ``rows``, whose values are
    decimals that are not negative. Calling this runs jobs.
    """
    kind = rows.schema[value].dataType
    cut = cut_value(slices, wanted)
    if cut is None:
        return rows.limit(0).withColumns(
            {"rank": F.lit(None).cast("bigint"), "running_total": F.lit(None).cast("decimal(38,2)")}
        )
    candidates = materialize(rows.where(F.col(value) >= F.lit(cut)), "candidates")
    borders = _borders(candidates, value, key, candidates.count()) or [(cut, "")]
    ranged = candidates.withColumn("range", _range(value, key, borders, kind.simpleString()))
    offsets = _offsets(ranged, value, borders, kind.simpleString())

    inside = Window.partitionBy("range").orderBy(F.desc(value), key)
    equal_too = Window.partitionBy("range").orderBy(F.desc(value))
    total = F.col("amount_before") + F.sum(value).over(equal_too)
    shared = F.when(F.col(value) == F.col("head"), F.col("head_total")).when(
        F.col(value) == F.col("tail"), F.col("tail_total")
    )
    return (
        ranged.repartitionByRange(len(borders) + 1, "range")
        .join(F.broadcast(offsets), "range")  # one row per range
        .withColumn("rank", F.col("rows_before") + F.row_number().over(inside))
        .withColumn("running_total", F.coalesce(shared, total))
        .where(F.col("rank") <= wanted)
        .select(*rows.columns, "rank", "running_total")
    )
