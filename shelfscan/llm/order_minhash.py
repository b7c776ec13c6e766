"""Order MinHash fingerprints of texts, in DataFrame expressions alone.

A text is a sequence of units and its k-mers are two neighbouring ones. The query takes words
between any white space, and instead of a word of more than LONG_WORD characters (as in scripts
without spaces) its overlapping pieces of PIECE characters; functions here take the parts between
single spaces unless they are given ``words_or_pieces``. Equal k-mers are told apart by the number of their occurrence. One 64-bit hash of k-mer
and occurrence stands for all random orders: its leading bits deal the k-mers out to BINS bins,
and in each bin the PICKED smallest are selected (in a bin with fewer, the next ones of the
following bins too), put back in text order and hashed together.
So an entry changes both when other k-mers occur and when the selected ones change places, as
the edit distance does. The likeness of two fingerprints is the share of bins, among those
filled in either, whose entries agree.

Nulls: a null text is empty. An empty text has an empty fingerprint; two empty ones are alike
(1.0), an empty and another not at all (0.0). By words or pieces, white space alone is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm.storage import partitions

BIN_BITS = 6
BINS = 1 << BIN_BITS
PICKED = 2
MOST_OCCURRENCES_BITS = 26
ENTRY_BITS = 32
LONG_WORD = 32
PIECE = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def between_spaces(text: Column) -> Column:
    """The parts of a text between single spaces."""
    return F.split(text, " ")


def words_or_pieces(text: Column) -> Column:
    """The words of a text between any white space; for a long one, the pieces that start at each character."""

    def pieces(word: Column) -> Column:
        return let(
            F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)),
            lambda chars: F.transform(
                chars, lambda c, i: F.concat(c, *(F.coalesce(F.get(chars, i + d), F.lit("")) for d in range(1, PIECE)))
            ),
        )

    def divided(words: Column) -> Column:
        units = F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, pieces(w)).otherwise(F.array(w)))
        return F.when(F.exists(words, lambda w: F.length(w) > LONG_WORD), F.flatten(units)).otherwise(words)

    return let(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), divided)


def _bin(code: Column) -> Column:
    return F.shiftrightunsigned(code, 64 - BIN_BITS)


def _occurrence(codes: Column, item: Column, place: Column) -> Column:
    """How many equal codes stand directly before ``place`` in a sorted array.

    Steps of halving length find the farthest equal one, so a text of one repeated word costs a
    few steps for each word, not all words before it.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MOST_OCCURRENCES_BITS))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda t, b: F.when(F.get(codes, place - t - b)["h"] == item["h"], t + b).otherwise(t),
    )
    return F.when(F.get(codes, place - 1)["h"] == item["h"], found).otherwise(F.lit(0))


def _entries(ranked: Column) -> Column:
    """One entry per filled bin from all (code, place) sorted by code, in the order of the bins.

    A bin's entry holds its PICKED smallest k-mers. Where it has fewer, those of the following bins
    (after the last: of the first) fill it up, so that every entry has an order.
    """
    first = lambda x, j: F.coalesce(_bin(F.get(ranked, j - 1)["code"]) != _bin(x["code"]), F.lit(True))

    def entry(x: Column, j: Column) -> Column:
        taken = [F.get(ranked, (j + F.lit(d)) % F.size(ranked)) for d in range(PICKED)]
        in_place = F.sort_array(F.array(*[F.struct(t["i"].alias("i"), t["code"].alias("code")) for t in taken]))
        hashed = let(in_place, lambda p: F.xxhash64(*[p[d]["code"] for d in range(PICKED)]))
        coded = F.shiftleft(hashed.bitwiseAND(F.lit((1 << (ENTRY_BITS - BIN_BITS)) - 1)), BIN_BITS)
        return F.when(first(x, j), F.struct(_bin(x["code"]).alias("bin"), coded.alias("coded")))

    found = F.sort_array(F.filter(F.transform(ranked, entry), lambda x: x.isNotNull()))
    return F.transform(found, lambda x: x["coded"] + x["bin"])


def signature(text: Column, units: Callable[[Column], Column] = between_spaces) -> Column:
    """The entries of a text as an array of longs: a hash above, the number of the bin in the lowest bits."""

    def coded(words: Column) -> Column:
        return F.sort_array(
            F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1)).alias("h"), i.alias("i")))
        )

    def numbered(codes: Column) -> Column:
        def number(x: Column, j: Column) -> Column:
            return let(
                _occurrence(codes, x, j),
                lambda n: F.struct(F.when(n == 0, x["h"]).otherwise(F.xxhash64(x["h"], n)).alias("code"), x["i"].alias("i")),
            )

        return F.sort_array(F.transform(codes, number))

    words = F.when(F.length(text) > 0, units(text)).otherwise(F.array().cast("array<string>"))
    return let(words, lambda w: let(coded(w), lambda c: let(numbered(c), _entries)))


def as_text(entries: Column) -> Column:
    """A signature as hexadecimal digits, eight for each filled bin."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either signature whose entries agree, from 0 to 1."""
    filled = F.size(
        F.array_union(
            F.transform(a, lambda x: x.bitwiseAND(F.lit(BINS - 1))), F.transform(b, lambda x: x.bitwiseAND(F.lit(BINS - 1)))
        )
    )
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / filled)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per document: doc_id and its fingerprint."""
    return documents.select("doc_id", as_text(signature(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def _range_of(doc_id: Column, bounds: list[float]) -> Column:
    """Number of the range between descending ``bounds`` that an id falls in; null ids come last."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(
        steps, F.lit(0), lambda t, b: F.when(F.get(edges, t + b - 1) > doc_id, t + b).otherwise(t)
    )
    return F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(below)


def with_next(documents: DataFrame, units: Callable[[Column], Column] = between_spaces) -> DataFrame:
    """Per document: doc_id, text, entries, and next_text and next_entries of the next smaller id.

    The documents are dealt out by ranges of ids and each range is one group of a window. At its
    end stands a copy of the next range's first document, so no row needs a second shuffle; after
    the last range comes the first. Equal ids are ordered by a hash of their texts.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("code", F.xxhash64("text"))
    ranges = 2 * partitions(spark)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(documents.approxQuantile("doc_id", shares, 0.25 / ranges)), reverse=True)
    keyed = documents.withColumn("range", _range_of(F.col("doc_id"), bounds))

    in_turn = Window.orderBy("range")
    heads = keyed.groupBy("range").agg(F.max(F.struct("doc_id", "code")).alias("head"))
    heads = heads.select(
        "head.doc_id",
        "head.code",
        F.coalesce(F.lag("range").over(in_turn), F.max("range").over(in_turn.rowsBetween(0, Window.unboundedFollowing))).alias("of"),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.code") == F.col("h.code"))
    tails = (
        documents.alias("d")
        .join(F.broadcast(heads.alias("h")), same)  # one row per range
        .select("d.doc_id", "d.text", "d.code", F.col("h.of").alias("range"))
        .dropDuplicates(["range"])
    )
    rows = keyed.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))
    order = Window.partitionBy("range").orderBy("tail", F.desc_nulls_last("doc_id"), F.desc("code"))
    return (
        rows.withColumn("entries", signature(F.col("text"), units))
        .withColumns({"next_text": F.lead("text").over(order), "next_entries": F.lead("entries").over(order)})
        .where("NOT tail")
        .select("doc_id", "text", "entries", "next_text", "next_entries")
    )


def compare_edited(documents: DataFrame, units: Callable[[Column], Column] = between_spaces) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last third comes from the next document."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third),
        F.substring(F.col("next_text"), F.lit(1), third),
    )
    return (
        with_next(documents, units)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_entries", signature(F.col("edited"), units))
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            as_text(F.col("entries")).alias("fingerprint"),
            as_text(F.col("edited_entries")).alias("edited_fingerprint"),
            likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
            likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
        )
    )
