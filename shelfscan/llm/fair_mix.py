"""Mixing sources to target weights by weighted fair queueing, in column expressions only.

Every source is a queue that holds its documents in a shuffled order, once for each pass. Served
at a rate in proportion to its target, a document's virtual finish time is the words of its
source up to its end, divided by the source's target. Sorting all documents by that time gives
the mix: at any point of it, each source has had its share. The mix ends where the total budget
is used up. A source ends at its target, in the middle of a document if need be, so what it
takes is its target but for a fraction of a word.

Targets are shares of the budget by weight; no source gets more than ``passes`` times its size,
and what it can't take is shared again by weight among the others. The level that this ends at is
found by Newton's steps on a concave function, each an aggregate over the sources.

The shuffle is the order of a SHA-256 of seed, id and text, so it depends on neither partitioning
nor storage order. Running totals inside a source are sums over bins of some BIN_ROWS documents
with neighbouring hashes, then of bins, then of lots of bins, so a source may hold any share of
the rows. Rows that are repeated in full are one row with a count until the end.

Nulls: a null text has no words, a null source is a source of its own, null ids are told apart by
their texts. A document without words is in no queue and takes none. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm.numbering import dealt_by_range, numbered, totals_before
from shelfscan.llm.storage import measured, store

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
PASSES = 2
SEED = "mix"
BIN_ROWS = 1024
BINS_IN_LOT = 1024
COPIES_IN_LOT = 65_536
WORD = r"[^\x20\x09-\x0D]+"

_KEY = ["source_no", "code", "doc_id"]


def code_of(seed: str = SEED) -> Column:
    """A hash of seed, id and text: 16 bytes that place a document in its source's shuffled order."""
    parts = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.unhex(F.substring(F.sha2(parts, 256), 1, 32))


def sized(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """Stored: doc_id, source, size (words), code, copies (rows that are equal in all of these)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = documents.select("doc_id", "source", size, code_of(seed).alias("code"))
    return store(rows.groupBy("doc_id", "source", "size", "code").agg(F.count("*").alias("copies")), "sized")


def sources_of(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Stored, per source: source_no (by code point, null last), source_size, n_rows, weight (repeating ``weights``)."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_rows"))
    ranked = numbered(sums, [F.col("source").asc_nulls_last()], "source_no")
    index = ((F.col("source_no") - 1) % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), index)
    return store(ranked.withColumn("weight", weight), "sources")


def targets(sources: DataFrame, budget: float, passes: int = PASSES) -> DataFrame:
    """``sources`` with target: the budget by weight, at most ``passes`` times a source's size, the rest shared again."""
    limit = (F.col("source_size") * passes).cast("double")
    full, level, size_full = F.lit(False), 0.0, None
    while True:
        sums = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * passes)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if sums["full"] == size_full or not sums["weight"]:
            break
        size_full, level = sums["full"], (budget - float(sums["full"])) / sums["weight"]
        full = F.lit(level) * F.col("weight") > limit
    return sources.withColumn("target", F.when(full, limit).otherwise(F.lit(level) * F.col("weight")))


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored ``rows`` with their source's columns and before: the words of the source that come earlier in its order."""
    draw = F.conv(F.hex(F.substring("code", 1, 4)), 16, 10).cast("long")
    bins = F.ceil(F.col("n_rows") / F.lit(BIN_ROWS))
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    binned = (
        rows.alias("d")
        .join(measured(sources).alias("s"), same)
        .select("d.*", "source_no", "source_size", "target", F.shiftright(draw * bins, 32).alias("bin"))
    )
    words = F.col("size") * F.col("copies")
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = store(
        binned.groupBy("source_no", "bin").agg(F.sum(words).alias("own")).withColumn("lot", F.expr(f"bin div {BINS_IN_LOT}")), "bins"
    )
    lots = (
        sums.groupBy("source_no", "lot")
        .agg(F.sum("own").alias("own"))
        .select("source_no", "lot", F.coalesce(F.sum("own").over(earlier("source_no").orderBy("lot")), F.lit(0)).alias("lots"))
    )
    in_lot = F.coalesce(F.sum("own").over(earlier("source_no", "lot").orderBy("bin")), F.lit(0))
    bases = sums.withColumn("bins", in_lot).join(lots, ["source_no", "lot"]).select("source_no", "bin", F.expr("bins + lots").alias("base"))
    in_bin = F.coalesce(F.sum(words).over(earlier("source_no", "bin").orderBy("code", "doc_id")), F.lit(0))
    return store(binned.join(bases, ["source_no", "bin"]).withColumn("before", F.col("base") + in_bin).drop("base", "bin"), "placed")


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each copy (from 0), a lot of them at a time."""
    lots = rows.withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES_IN_LOT})")))
    last = f"least((lot + 1) * {COPIES_IN_LOT}L, copies) - 1"
    return lots.withColumn("copy", F.explode(F.expr(f"sequence(lot * {COPIES_IN_LOT}L, {last})"))).drop("lot", "copies")


def schedule(queued: DataFrame, budget: float, passes: int = PASSES) -> DataFrame:
    """The mix in order: source_no, code, doc_id, copy, pass, words, finish, position (from 1).

    Words of a document that its source's target or the total budget leaves out are not in it.
    """
    start = F.col("pass") * F.col("source_size") + F.col("before") + F.col("copy") * F.col("size")
    words = F.least(F.col("size"), F.floor("target") - F.col("start"))
    entries = (
        _copies(queued.where("size > 0"))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("start", start)
        .withColumn("words", words)
        .where("words > 0")
        .withColumn("finish", F.try_divide(F.col("start") + F.col("words"), F.col("target")))
        .select(*_KEY, "copy", "pass", "words", "finish")
    )
    dealt = dealt_by_range(entries, ["finish", *_KEY, "copy", "pass"], "entries")
    bases = store(totals_before(dealt, F.col("words")), "ranges")
    whole = int(budget)
    ranged = dealt.join(F.broadcast(bases), "part")  # one row per range
    inside = ranged.where(F.col("before") + F.col("own") <= whole).withColumn("left", F.col("words"))
    # only the range that the budget ends in has to be looked at row by row
    running = F.sum("words").over(Window.partitionBy("part").orderBy("place"))
    last = (
        ranged.where((F.col("before") < whole) & (F.col("before") + F.col("own") > whole))
        .withColumn("left", F.least(F.col("words"), F.lit(whole) - F.col("before") - running + F.col("words")))
        .where("left > 0")
    )
    position = F.col("rows_before") + F.col("place") + 1
    return inside.unionByName(last).select(*_KEY, "copy", "pass", F.col("left").alias("words"), "finish", position.alias("position"))


def _queues(documents: DataFrame, weights, share_percent: int, passes: int, seed: str) -> tuple[DataFrame, float]:
    """All documents in their sources' orders, and the total budget."""
    rows = sized(documents, seed)
    sources = sources_of(rows, weights)
    budget = share_percent * (sources.agg(F.sum("source_size")).first()[0] or 0) / 100
    return placed(rows, store(targets(sources, budget, passes), "targets")), budget


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    passes: int = PASSES,
    seed: str = SEED,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words in the mix, over all passes), source."""
    queued, budget = _queues(documents, weights, share_percent, passes, seed)
    own = ["size", "source_size", "target", "source"]
    every = _copies(queued).select(*_KEY, "copy", *own, F.lit(0).cast("long").alias("words"))
    empty = [F.lit(None).cast(queued.schema[c].dataType).alias(c) for c in own]
    took = schedule(queued, budget, passes).select(*_KEY, "copy", *empty, "words")
    return (
        every.union(took)
        .groupBy(*_KEY, "copy")
        .agg(*[F.max(c).alias(c) for c in own], F.sum("words").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "source")
    )


def mixed(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    passes: int = PASSES,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself, sorted: position, pass, words (how many of the document's words are in it), doc_id, source, text."""
    queued, budget = _queues(documents, weights, share_percent, passes, seed)
    order = schedule(queued, budget, passes)
    texts = documents.select(code_of(seed).alias("code"), "source", "text").dropDuplicates(["code", "source"])
    names = queued.select("source_no", "source").distinct()
    entries = order.join(measured(store(names, "names")), "source_no").alias("e")
    same = (F.col("e.code") == F.col("t.code")) & F.col("e.source").eqNullSafe(F.col("t.source"))
    return entries.join(texts.alias("t"), same).select("position", "pass", "words", "doc_id", "e.source", "text").orderBy("position")
