"""Near-duplicate documents by min-max hashing.

A document is its set of distinct shingles. Under each permutation both the smallest and the
largest value are kept, which gives two signature entries for one evaluation of the hash; the
two are estimates of the same similarity that vary less together than two independent minima.
Runs of entries form bands, and documents that share a band are candidates.

Documents with equal sets form a class and go on as one node, so exact copies cost nothing. In
each bucket of a band the members are compared with one leader, not with each other; links are
confirmed on the full sets, read again from the texts. Pairs that share a bucket but not yet a
component are then looked for by their differences, so no candidate pair is left out; buckets
whose members are in one component need nothing more.

Bands are as wide as MISSED allows: a pair at the threshold shares none of them with at most that
probability, one above it with less, and equal sets share all.

Groups of copies often have many members just below the threshold, which share most shingles with
all others; comparing each with each is what such a group would cost. So its members are reduced
to what sets them apart: the shingles in which they differ from what most of the group has. How
many of these two members must have in common to be alike enough follows exactly from sizes. Most
members have too few that anyone shares; the rest are joined on the rarest of them only, as many
as it takes not to miss a pair.

Nulls and ties: a null or empty text, or one without words, has no shingles and no links. Null
ids are kept as one id after all others. Rows that share an id are documents of their own with
that id. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscan.llm import arrays
from shelfscan.llm.components import components
from shelfscan.llm.storage import measured, release, store

LAST_ID = (1 << 63) - 1  # stands for a null id
PERMUTATIONS = 160
MISSED = 1e-5
SALTS = 1024
CENTRE_MEMBERS = 64

_FACTORS = arrays.weights(PERMUTATIONS, 11)
_SHIFTS = arrays.weights(PERMUTATIONS, 12)


def shingle_sets(column, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, number of texts, and their distinct (text, shingle hash) pairs, by slices.

    A text with fewer words than a shingle has all of them as its one shingle.
    """
    for first, data, bounds in arrays.text_slices(column):
        n = len(bounds) - 1
        codes, text = arrays.words_of(data, bounds, lower=True)
        whole = np.flatnonzero(text[: max(0, len(text) - words + 1)] == text[words - 1 :])
        owner, shingle = text[whole], arrays.window_hash(codes, words)[whole]
        counts = np.bincount(text, minlength=n)
        for w in range(1, words):
            short = np.flatnonzero(counts == w)
            begin = np.searchsorted(text, short)
            joined = np.full(len(short), arrays.mix(np.array([w], arrays.U64))[0])
            for j, weight in enumerate(arrays.weights(w, 20 + w)):
                joined = joined + codes[begin + j] * weight
            owner, shingle = np.r_[owner, short], np.r_[shingle, arrays.mix(joined)]
        yield first, n, *arrays.distinct(owner, shingle)


def min_max(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Smallest and largest value of each set under each permutation: one row per set."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), arrays.U64)
    if len(starts) == 0:
        return out
    for p in range(PERMUTATIONS):
        values = shingle * _FACTORS[p] + _SHIFTS[p]
        out[:, p] = np.minimum.reduceat(values, starts)
        out[:, PERMUTATIONS + p] = np.maximum.reduceat(values, starts)
    return out


def band_width(percent: int) -> int:
    """Entries to a band, the most that miss a pair at the threshold with a probability of MISSED or less."""
    width = 1
    while (1 - (percent / 100) ** (width + 1)) ** (2 * PERMUTATIONS // (width + 1)) <= MISSED:
        width += 1
    return width


def band_keys(signature: np.ndarray, width: int) -> np.ndarray:
    """One key per band and row, different for different bands."""
    bands = signature.shape[1] // width
    keys = np.empty((len(signature), bands), arrays.U64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, arrays.U64)
        for j, w in enumerate(arrays.weights(width, 13)):
            key += signature[:, b * width + j] * w
        keys[:, b] = arrays.mix(key)
    return keys


def _set_codes(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    return arrays.mix(np.add.reduceat(arrays.mix(shingle), starts)) if len(starts) else np.zeros(0, arrays.U64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signatures(documents: DataFrame, words: int, band: int) -> DataFrame:
    """Per document: doc_id, text_code, n_shingles, node (hash of the set), bands (null without shingles)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, text, shingle in shingle_sets(batch.column("text"), words):
                sizes = np.bincount(text, minlength=n)
                filled = np.flatnonzero(sizes)
                starts = np.r_[0, np.cumsum(sizes[filled])[:-1]] if len(filled) else filled
                keys = band_keys(min_max(shingle, starts), band)
                nodes = np.zeros(n, arrays.U64)
                nodes[filled] = _set_codes(shingle, starts)
                offsets = np.r_[0, np.cumsum(np.where(sizes > 0, keys.shape[1], 0))].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), _signed(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        batch.column("text_code").slice(first, n),
                        pa.array(sizes.astype(np.int64)),
                        _signed(nodes),
                        bands,
                    ],
                    ["doc_id", "text_code", "n_shingles", "node", "bands"],
                )

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_code")).mapInArrow(
        signed, "doc_id long, text_code long, n_shingles long, node long, bands array<long>"
    )


def full_sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Per wanted node (doc_id, text_code, node): its shingle hashes, from the text of the document named."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("node").to_numpy()
            for first, n, text, shingle in shingle_sets(batch.column("text"), words):
                sizes = np.bincount(text, minlength=n)
                filled = np.flatnonzero(sizes)
                starts = np.r_[0, np.cumsum(sizes[filled])[:-1]] if len(filled) else filled
                nodes = np.zeros(n, arrays.U64)
                nodes[filled] = _set_codes(shingle, starts)
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), _signed(shingle))
                same = pa.array((nodes.view(np.int64) == asked[first : first + n]) & (sizes > 0))
                found = pa.RecordBatch.from_arrays([_signed(nodes), sets], ["node", "shingles"])
                yield found.filter(same)

    return (
        documents.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_code"))
        .join(measured(wanted), ["doc_id", "text_code"])
        .select("node", "text")
        .mapInArrow(read, "node long, shingles array<long>")
        .dropDuplicates(["node"])
    )


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """Per node that can have a link at all: node, n (size of its set), held (shingles that others hold too)."""
    shingles = sets.select("node", F.explode("shingles").alias("shingle"))
    alone = (
        shingles.groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.min("node").alias("node"))
        .where("holders = 1")
        .groupBy("node")
        .agg(F.count("*").alias("alone"))
    )
    n = F.size("shingles").cast("long")
    return (
        sets.select("node", n.alias("n"))
        .join(alone, "node", "left")
        .select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("held"))
        .where(F.lit(100) * F.col("held") >= F.lit(percent) * F.col("n"))
    )


def _can_link(a: str, b: str, percent: int):
    """Whether two members may be alike enough: they share at most the shingles that the one with fewer shared ones has."""
    most = F.least(F.col(f"{a}.held"), F.col(f"{b}.held"))
    return F.lit(100) * most >= F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct ``pairs`` (a, b) those whose sets are alike enough.

    ``b`` may occur in very many pairs; its set is copied for each salt in use, and a pair's salt
    comes from its other side.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    left = salted.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("own")), "a")
    right = (
        salted.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b")
    )
    shared = F.size(F.array_intersect("own", "other"))
    return (
        left.join(right, ["b", "salt"])
        .select("a", "b", shared.cast("long").alias("shared"), (F.size("own") + F.size("other")).cast("long").alias("total"))
        .where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("total") - F.col("shared")))
        .select("a", "b")
    )


def _open_buckets(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (bucket, node, n, held, label) of buckets that hold more than one component."""
    if labels is None:
        labelled = members.withColumn("label", F.col("node"))
    else:
        labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return labelled.join(several.select("bucket"), "bucket")


def _leader_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member with the leader of its bucket, if their components differ and they may be alike.

    The leader is the member whose shingles the others share most.
    """
    rank = F.struct(F.col("n") - F.col("held"), "node")
    leaders = members.groupBy("bucket").agg(F.min_by(F.struct("node", "label", "n", "held"), rank).alias("leader"))
    return (
        members.alias("m")
        .join(leaders.select("bucket", "leader.*").alias("l"), "bucket")
        .where((F.col("m.label") != F.col("l.label")) & _can_link("m", "l", percent))
        .select(F.col("m.node").alias("a"), F.col("l.node").alias("b"))
        .distinct()
    )


def _groups(members: DataFrame) -> DataFrame:
    """(pivot, node, label) of open buckets: members that share a bucket share its pivot.

    A bucket's pivot is its member that is in most open buckets, so a few pivots stand for all
    buckets of a group of copies.
    """
    busy = members.groupBy("node").agg(F.count("*").alias("buckets"))
    pivots = members.join(busy, "node").groupBy("bucket").agg(F.max_by("node", F.struct("buckets", "node")).alias("pivot"))
    return members.join(pivots, "bucket").select("pivot", "node", "label").distinct()


def _centres(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Per pivot the shingles that at least half of up to CENTRE_MEMBERS of its members have.

    What they are decides only how much work follows, not what is found.
    """
    order = Window.partitionBy("pivot").orderBy(F.xxhash64("node"), "node")
    sample = groups.withColumn("at", F.row_number().over(order)).where(F.col("at") <= CENTRE_MEMBERS).select("pivot", "node")
    sizes = sample.groupBy("pivot").agg(F.count("*").alias("members"))
    counts = (
        sample.join(sets, "node")
        .select("pivot", F.explode("shingles").alias("shingle"))
        .groupBy("pivot", "shingle")
        .agg(F.count("*").alias("holders"))
        .join(sizes, "pivot")
        .where("2 * holders >= members")
    )
    return counts.groupBy("pivot").agg(F.collect_list("shingle").alias("centre"))


def differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Per (pivot, node): label, far, and the shingles in which it differs from the centre (array ``other``).

    For sets A and B that differ from the centre in Da and Db, A and B differ in |Da| + |Db| -
    2 |Da & Db| shingles, and they are alike enough if that is at most (100 - percent) (|A| + |B|)
    / (100 + percent). With ``far`` = (100 + percent) |D| - (100 - percent) |A| this says that Da
    and Db must have (far + far) / (2 (100 + percent)) shingles in common or more.
    """
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    centres = salted.select("pivot", "salt").distinct().join(store(_centres(groups, sets), "centres"), "pivot", "left")
    centre = F.coalesce("centre", F.array().cast("array<bigint>"))
    other = F.concat(F.array_except("shingles", centre), F.array_except(centre, "shingles"))
    far = F.lit(100 + percent) * F.size("other").cast("long") - F.lit(100 - percent) * F.size("shingles").cast("long")
    return (
        salted.join(sets, "node")
        .join(centres, ["pivot", "salt"])
        .withColumn("other", other)
        .select("pivot", "node", "label", far.cast("long").alias("far"), "other")
    )


def _certain_pairs(differing: DataFrame) -> DataFrame:
    """Each node that needs nothing in common with the nearest of its group, with that one.

    Two nodes that need nothing in common with each other both need nothing in common with the
    nearest one, so these pairs join all that such pairs would.
    """
    nearest = differing.groupBy("pivot").agg(F.min_by(F.struct("node", "label", "far"), F.struct("far", "node")).alias("x"))
    return (
        differing.drop("other")
        .join(nearest.select("pivot", "x.*").withColumnsRenamed({"node": "a", "label": "x_label", "far": "x_far"}), "pivot")
        .where((F.col("far") + F.col("x_far") <= 0) & (F.col("label") != F.col("x_label")))
        .select("a", F.col("node").alias("b"))
    )


def _meeting_pairs(differing: DataFrame, percent: int) -> DataFrame:
    """Pairs that have one of the rarest shingles of their differences in common.

    Only shingles that two members or more differ in can be in common, so only those count. If two
    lists, rarest first, have k elements in common, then one of these is among the first
    (length - k + 1) of either list. How many a pair needs follows from ``far`` of both, and the
    place of the shingle in both lists is checked in the join, so that almost no other pair comes
    out of it.
    """
    step = 2 * (100 + percent)
    shingles = differing.select("pivot", "node", "label", "far", F.explode("other").alias("shingle"))
    shared = shingles.groupBy("pivot", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    nearest = differing.groupBy("pivot").agg(F.min("far").alias("least_far"))
    lists = (
        shingles.join(shared, ["pivot", "shingle"])
        .groupBy("pivot", "node", "label", "far")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("list"))
        .join(nearest, "pivot")
        .withColumn("n", F.size("list").cast("long"))
        .withColumn("least", F.greatest(F.lit(1), F.ceil((F.col("far") + F.col("least_far")) / step)))
        .where("n >= least")
        .withColumn("head", F.slice("list", 1, F.greatest(F.col("n") - F.col("least") + 1, F.lit(0)).cast("int")))
        .select("pivot", "node", "label", "far", "n", F.posexplode("head").alias("place", "x"))
        .select("pivot", "node", "label", "far", "n", "place", "x.shingle")
    )
    lists = store(lists, "difference_heads")
    common = F.ceil((F.col("a.far") + F.col("b.far")) / step)
    same = (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.shingle") == F.col("b.shingle"))
    reached = (F.col("a.place") + common <= F.col("a.n")) & (F.col("b.place") + common <= F.col("b.n"))
    other = (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    return (
        lists.alias("a")
        .join(lists.alias("b"), same & other & (common >= 1) & reached)
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    )


def _difference_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket and different components that may be alike enough, and enough of those that surely are."""
    differing = store(differences(store(_groups(members), "groups"), sets, percent), "differences")
    return _certain_pairs(differing).union(_meeting_pairs(differing, percent)).distinct()


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, the text_code that tells rows of one id apart, and first.

    ``first`` marks one text of each component, that of the smallest id and then text_code.
    Documents whose sets have ``percent`` of their union in common are linked; component_id is the
    smallest id reachable, and the document that has it is kept.
    """
    spark: SparkSession = documents.sparkSession
    signed = store(signatures(documents, words, band_width(percent)), "signatures")
    own_id = F.coalesce("doc_id", F.lit(LAST_ID))
    classes = store(
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(F.min(F.struct(own_id.alias("rep"), "text_code")).alias("rep"), F.first("bands").alias("bands"))
        .select("node", "rep.rep", "rep.text_code", "bands"),
        "classes",
    )
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    candidates = store(buckets.join(shared.select("bucket"), "bucket"), "candidates")
    reps = classes.select(F.col("rep").alias("doc_id"), "text_code", "node")
    wanted = store(reps.join(candidates.select("node").distinct(), "node"), "wanted")
    release(spark)
    sets = store(full_sets(documents, wanted.select("doc_id", "text_code", "node"), words), "sets")
    release(spark)
    members = store(candidates.join(store(linkable(sets, percent), "linkable"), "node"), "members")
    release(spark)

    labels, links, checked = None, None, None

    def settle(pairs: DataFrame) -> None:
        """Confirm pairs that are new and renew the labels."""
        nonlocal labels, links, checked
        if checked is not None:
            seen = checked.union(checked.select("b", "a"))
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        found = store(confirm(pairs, sets, percent), "confirmed")
        checked = pairs if checked is None else checked.union(pairs)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = components(links)
        release(spark)

    settle(_leader_pairs(_open_buckets(members, None), percent))
    open_buckets = store(_open_buckets(members, labels), "open")
    if not open_buckets.isEmpty():
        settle(_difference_pairs(open_buckets, sets, percent))

    if labels is None:
        named = classes.select("node", F.col("rep").alias("component"), F.col("text_code").alias("first_code"))
    else:
        labelled = classes.select("node", "rep", "text_code").join(labels, "node", "left")
        labelled = labelled.withColumn("label", F.coalesce("label", "node"))
        least = labelled.groupBy("label").agg(F.min(F.struct("rep", "text_code")).alias("x"))
        named = labelled.join(least, "label").select("node", F.col("x.rep").alias("component"), F.col("x.text_code").alias("first_code"))
    component = F.coalesce("component", own_id)
    first = (own_id == F.col("component")) & ((F.col("n_shingles") == 0) | (F.col("text_code") == F.col("first_code")))
    return (
        signed.select("doc_id", "n_shingles", "node", "text_code")
        .join(store(named, "named"), ["node"], "left")
        .withColumn("component", F.when(F.col("n_shingles") > 0, component).otherwise(own_id))
        .select(
            "doc_id",
            "n_shingles",
            F.nullif("component", F.lit(LAST_ID)).alias("component_id"),
            (own_id == F.col("component")).alias("kept"),
            "text_code",
            first.alias("first"),
        )
    )


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near copies of one with a smaller id; all columns as they were.

    Rows that repeat one id and text are one document and stay or go together. Of near copies, or
    copies, that all lack an id one row stays. A document without shingles always stays.
    """
    marked = store(near_duplicates(documents, words, percent), "marked")
    gone = store(marked.where("NOT first").select("doc_id", "text_code").distinct(), "gone")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_code"))
    kept = documents.alias("d").join(measured(gone).alias("g"), same, "left_anti")
    if marked.where("doc_id IS NULL AND n_shingles > 0").isEmpty():
        return kept
    kept = store(kept, "kept")
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = kept.where(nameless).withColumn("_code", F.xxhash64("text")).dropDuplicates(["_code"]).drop("_code")
    return kept.where(~nameless).unionByName(single)
