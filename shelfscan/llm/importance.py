"""Resampling documents towards a target distribution by importance weights over hashed word runs.

Features of a text are its runs of one to three neighbouring words, each in the bucket that the
CRC-32 of its bytes gives. Counts of all documents and of the target texts per bucket give each
bucket a gain, the log ratio of its smoothed shares; a document weighs the sum over its features.
Gumbel noise, fixed by the id, turns the highest scores into a draw without replacement.

CRCs are taken of many features at once: the distinct features of a block of words (told apart
exactly, by codes of words and of word pairs) are grouped by length into two-dimensional byte
arrays, and one step of the table-driven CRC is done for a whole column. Groups of fewer than
MATRIX_ROWS features, such as those with very long words, are hashed one by one with the same
result. The buckets are scattered back to the places of the features and stored, two bytes for
each, so that texts are read once, and never shuffled.

Nulls: a null text has no words, features or weight; null ids share the noise of an empty id and
are ranked after all others. Rows that are repeated have equal scores; as many of them are drawn
as there are ranks. A table without target texts or documents works with counts of zero.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm import arrays
from shelfscan.llm.numbering import dealt_by_range, totals_before
from shelfscan.llm.storage import measured, store

RUN = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK_WORDS = 1 << 18
MATRIX_ROWS = 64

_IN_WORD = arrays.byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_TABLE = _crc_table()


def crc32_matrix(matrix: np.ndarray) -> np.ndarray:
    """The CRC-32 of each row of a two-dimensional array of bytes, all rows' next byte at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data`` (none empty), by matrices of spans of one length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        length = int(lengths[rows[0]])
        if len(rows) < MATRIX_ROWS:
            out[rows] = [zlib.crc32(data[a : a + length]) for a in starts[rows].tolist()]
        else:
            out[rows] = crc32_matrix(np.lib.stride_tricks.sliding_window_view(data, length)[starts[rows]])
    return out


def _distinct_buckets(keys: np.ndarray, places: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The bucket of each feature, and its code: equal features have equal ``keys``."""
    _, first, codes = np.unique(keys, return_index=True, return_inverse=True)
    at = places[first]
    return (crc32_of(data, starts[at], ends[at] - starts[at]) % BUCKETS).astype(np.uint16)[codes], codes


def _block(words: np.ndarray, text: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: int):
    """Buckets of the runs that begin at the first ``own`` words of a block: (word, run length) array, and which exist."""
    buckets, there = np.zeros((own, RUN), np.uint16), np.zeros((own, RUN), bool)
    codes, n = words.astype(np.int64), len(words)
    for run in range(1, RUN + 1):
        begins = np.arange(max(0, n - run + 1))
        if run > 1:  # a run is the run before it and one word more
            codes = (codes[: len(begins)] << 32) | words[run - 1 :]
        whole = text[begins] == text[begins + run - 1]
        found, shorter = _distinct_buckets(codes[whole], begins[whole], data, starts, ends[run - 1 :])
        codes = np.zeros(len(begins), np.int64)
        codes[whole] = shorter
        kept = begins[whole] < own
        buckets[begins[whole][kept], run - 1] = found[kept]
        there[begins[whole][kept], run - 1] = True
    return buckets, there


def bucket_slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First text, number of texts, and their words, features, and buckets of all features in order, by slices."""
    for first, data, bounds in arrays.text_slices(column):
        n = len(bounds) - 1
        data = arrays.LOWER[data]
        inside = _IN_WORD[data]
        starts, ends, text = arrays.spans(inside, bounds)
        lengths = ends - starts
        letters = data[inside]
        edges = np.r_[0, np.cumsum(lengths)]
        spaced = np.full(len(letters) + len(starts), 0x20, np.uint8)  # all words, one space behind each
        spaced[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), lengths)] = letters
        begin = edges[:-1] + np.arange(len(starts))
        named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
        codes = named.dictionary_encode().indices.to_numpy()
        parts, sizes = [np.zeros(0, np.uint16)], np.zeros(n, np.int64)
        for a in range(0, len(starts), BLOCK_WORDS):
            b = min(a + BLOCK_WORDS, len(starts))
            upto = min(b + RUN - 1, len(starts))
            buckets, there = _block(codes[a:upto], text[a:upto], spaced, begin[a:upto], begin[a:upto] + lengths[a:upto], b - a)
            parts.append(buckets[there])
            sizes += np.bincount(text[a:b], weights=there.sum(axis=1), minlength=n).astype(np.int64)
        yield first, n, np.bincount(text, minlength=n), sizes, np.concatenate(parts)


def features(documents: DataFrame) -> DataFrame:
    """Per document: part and place (of the row in its task), doc_id, text_code, n_words, n_features, buckets (binary)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, n, words, sizes, buckets in bucket_slices(batch.column("text")):
                edges = (2 * np.r_[0, np.cumsum(sizes)]).astype(np.int32)
                blobs = pa.BinaryArray.from_buffers(
                    pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(buckets.astype("<u2"))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int64)),
                        pa.array(np.arange(place, place + n)),
                        batch.column("doc_id").slice(first, n),
                        batch.column("text_code").slice(first, n),
                        pa.array(words.astype(np.int64)),
                        pa.array(sizes),
                        blobs,
                    ],
                    ["part", "place", "doc_id", "text_code", "n_words", "n_features", "buckets"],
                )
                place += n

    schema = "part long, place long, doc_id long, text_code long, n_words long, n_features long, buckets binary"
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_code")).mapInArrow(hashed, schema)


def _buckets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The buckets of each row."""
    column = batch.column("buckets").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data or b"", np.uint8)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield every[a:b].view("<u2")


def bucket_counts(featured: DataFrame) -> DataFrame:
    """Per bucket that occurs: bucket, n. Each task counts its own rows first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets in _buckets_of(batch):
                counts += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    tasks = featured.select("buckets").mapInArrow(counted, "bucket long, n long")
    return tasks.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """A thousandfold log ratio of the smoothed shares of each bucket, rounded down."""
    all_corpus, all_target = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return np.array(
        [
            math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_corpus / ((corpus.get(b, 0) + 1.0) * all_target)))
            for b in range(BUCKETS)
        ],
        np.int64,
    )


def weighted(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` with weight in place of the buckets."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[buckets].sum()) for buckets in _buckets_of(batch)]
            names = [name for name in batch.schema.names if name != "buckets"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(weights, pa.int64())], [*names, "weight"])

    schema = "part long, place long, doc_id long, text_code long, n_words long, n_features long, weight long"
    return featured.mapInArrow(summed, schema)


def _collected(counts: DataFrame) -> dict[int, int]:
    return {r["bucket"]: r["n"] for r in counts.collect()}  # at most BUCKETS rows


def noise():
    """Gumbel noise of a document, a thousandfold and rounded down, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (from 1, null if not drawn), n_words, text_code.

    Of the documents with ``min_words`` or more, ``percent`` in a hundred are drawn. Documents with
    smaller ids come first among equal scores.
    """
    featured = store(features(documents), "features")
    ids = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(_collected(bucket_counts(featured)), _collected(bucket_counts(features(ids))))
    scored = weighted(featured, gain).withColumn("score", (F.col("weight") + noise()).cast("long"))
    allowed = F.col("n_words") >= min_words
    order = [F.desc("allowed"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row_part"), F.col("row_place")]
    named = scored.withColumn("allowed", allowed).withColumnsRenamed({"part": "row_part", "place": "row_place"})
    dealt = dealt_by_range(named, order, "scored")
    drawn = dealt.where("allowed").count() * percent // 100
    number = F.col("rows_before") + F.col("place") + 1
    return (
        dealt.join(F.broadcast(totals_before(dealt)), "part")  # one row per range
        .withColumn("rank", F.when(F.col("allowed") & (number <= drawn), number))
        .select("doc_id", "n_features", "weight", "score", "rank", "n_words", "text_code")
    )


def drawn(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents drawn, with all their columns. Rows that repeat one id and text are drawn together."""
    chosen = resample(documents, target, percent, min_words).where("rank IS NOT NULL").select("doc_id", "text_code").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("c.text_code"))
    return documents.alias("d").join(measured(store(chosen, "chosen")).alias("c"), same, "left_semi")
