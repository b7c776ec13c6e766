"""Removal of passages that an earlier document has, by sorting suffixes bucket by bucket.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller
id. To find those strings, suffixes need to be told apart to LENGTH bytes only, and only those
that can have an equal elsewhere need to be sorted:

1. A cover of sample positions is laid over each text: in every string of LENGTH bytes the
   SAMPLE-byte string with the smallest hash is sampled. Equal strings have equal samples at the
   same offset, so the sample is both the bucket of a suffix and the anchor of its comparison.
   Suffixes next to each other that have the same sample form a run.
2. Samples are counted over chunks of documents. Each chunk sends a sample once and is told which
   of its samples occur elsewhere; runs of all others are unique and go no further.
3. A bucket whose runs all have the same bytes needs no sorting: its runs are covered as a whole
   but for those of the smallest id. Only the others are shuffled with their bytes.
4. Those are sorted one bucket at a time: within a bucket, suffixes are ordered by the names of
   the blocks that cover their LENGTH bytes, and equal neighbours get the smallest id among them.
   A bucket with more than HOT_RUNS runs is collapsed to its distinct runs, whose suffixes are
   spread over many tasks instead.
5. Each chunk's documents meet their covered spans and are cut.

A classic difference cover samples positions by their residue. That takes 6 positions of 31 for
the same 50 bytes, against one of 16 here, and three times the rows to be shuffled.

Each group that is gathered in a task is bounded: by the bytes of a chunk, or by the runs of a
bucket.

Nulls: a null text is empty (and stays null where texts are returned); null ids count as larger
than all others. Rows with one id don't cover each other. A text shorter than LENGTH is left
alone. Where a cut leaves part of a character, that part is dropped from the returned text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscan.llm import arrays
from shelfscan.llm.storage import measured, partitions, release, store

LENGTH = 50
SAMPLE = 20
BLOCK = 16
CHUNK_BYTES = 16 << 20
HOT_RUNS = 1 << 16  # some 100 MB while they are sorted
LOT_RUNS = 4096  # runs that are sorted at a time, and the bucket that the last of them is in
MIXED_BROADCAST_ROWS = 1 << 20  # of 9 bytes
LAST_ID = (1 << 63) - 1
U64 = arrays.U64
_FACTOR = U64(0x9E3779B97F4A7C15)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two neighbours, in this order."""
    return (left ^ (left >> U64(29))) * _FACTOR + right


def block_names(data: np.ndarray) -> np.ndarray:
    """A hash of the BLOCK bytes from each position on; too near to the end there are none."""
    names, size = data.astype(U64) + U64(1), 1
    names = names * U64(0xD6E8FEB86659FD93)
    while size < BLOCK:
        names = _join(names[: max(0, len(names) - size)], names[size:])
        size *= 2
    return names


def suffix_names(blocks: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each position on, from the blocks that cover them."""
    n = max(0, len(blocks) - (LENGTH - BLOCK))
    name = blocks[:n]
    for offset in (BLOCK, 2 * BLOCK, LENGTH - BLOCK):
        name = _join(name, blocks[offset : offset + n])
    return arrays.mix(name)


def sample_keys(blocks: np.ndarray) -> np.ndarray:
    """The smallest hash of a SAMPLE-byte string within the LENGTH bytes from each position on."""
    n = max(0, len(blocks) - (SAMPLE - BLOCK))
    least = arrays.mix(_join(blocks[:n], blocks[SAMPLE - BLOCK : SAMPLE - BLOCK + n]))
    width, reach = LENGTH - SAMPLE + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[: max(0, len(least) - reach)], least[reach:])
        reach *= 2
    rest = width - reach
    n = max(0, len(least) - rest)
    return np.minimum(least[:n], least[rest : rest + n])


def _over_texts(flags: np.ndarray, bounds: np.ndarray, reach: int) -> np.ndarray:
    """``flags`` without the positions of which ``reach`` bytes would leave their text."""
    edges = np.zeros(bounds[-1] + 1, np.int32)
    np.add.at(edges, np.maximum(bounds[1:] - (reach - 1), bounds[:-1]), 1)
    np.add.at(edges, bounds[1:], -1)
    return flags & (np.cumsum(edges[:-1])[: len(flags)] == 0)


class Runs:
    """The runs of a slice of texts: first position, number of suffixes, text and key of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.blocks = block_names(data)
        keys = sample_keys(self.blocks)
        inside = _over_texts(np.ones(len(keys), bool), bounds, LENGTH)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | ~inside[:-1]
        new[bounds[:-1][bounds[:-1] < len(keys)]] = True
        new &= inside
        self.at = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= new[1:] | ~inside[1:]
        self.counts = np.flatnonzero(last) - self.at + 1
        self.text = np.searchsorted(bounds, self.at, side="right") - 1
        self.keys = keys[self.at]

    def names(self, which: np.ndarray) -> np.ndarray:
        """A hash of the bytes of some runs."""
        if len(which) == 0:
            return np.zeros(0, U64)
        counts = self.counts[which]
        first = np.cumsum(counts) - counts
        order = np.arange(int(counts.sum())) - np.repeat(first, counts)
        place = np.repeat(self.at[which], counts) + order
        name = self.blocks[place]
        for offset in (BLOCK, 2 * BLOCK, LENGTH - BLOCK):
            name = _join(name, self.blocks[place + offset])
        weighted = arrays.mix(name) * arrays.weights(int(counts.max()), 31)[order]
        return arrays.mix(np.add.reduceat(weighted, first) + counts.astype(U64))


def _slices(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return arrays.text_slices(table.column("text"))


def _bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key and its name of 32 bits there; a filter may confuse a few names."""
    return ((keys >> U64(32)) % U64(buckets)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.uint32)


def _sampled(buckets: int):
    """Chunk -> per bucket the samples of the chunk, each once, and which of them several documents have."""

    def sampled(key: tuple, table: pa.Table) -> pa.Table:
        seen = []
        for first, data, bounds in _slices(table):
            runs = Runs(data, bounds)
            text, keys = arrays.distinct(runs.text, runs.keys)
            seen.append(keys)
        keys, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, U64), return_counts=True)
        bucket, name = _bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, name, several = bucket[order], name[order], counts[order] > 1
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(bucket)] if len(cuts) else cuts
        return pa.table(
            {
                "chunk": pa.array(np.full(len(cuts), key[0].as_py(), np.int64)),
                "bucket": pa.array(bucket[cuts]),
                "names": pa.array([name[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            }
        )

    return sampled


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Bucket -> for each chunk, which of its samples occur in another document."""
    blobs = [np.frombuffer(b, np.uint32) for b in table.column("names").to_pylist()]
    several = [
        np.unpackbits(np.frombuffer(b, np.uint8), count=len(names)).astype(bool)
        for b, names in zip(table.column("several").to_pylist(), blobs, strict=True)
    ]
    names = np.concatenate(blobs)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.concatenate(several)
    twice = np.r_[False, same] | np.r_[same, False]
    shared[order[twice]] = True
    # A name that one chunk has in several documents is shared there; elsewhere it is found twice.
    out, at = [], 0
    for blob in blobs:
        out.append(blob[shared[at : at + len(blob)]].tobytes())
        at += len(blob)
    kept = pa.array([bool(b) for b in out], pa.bool_())
    table = table.select(["chunk", "bucket"]).append_column("names", pa.array(out, pa.binary()))
    return table.filter(kept)


_RUNS = "owner long, doc_id long, at int, n int, key long, name long, bytes binary"


def _shared_runs(buckets: int):
    """Chunk and its shared samples -> the runs around them, with their bytes."""

    def found(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        wanted = np.zeros(0, U64)
        if shared.num_rows:
            sizes = [len(b) // 4 for b in shared.column("names").to_pylist()]
            names = np.frombuffer(b"".join(shared.column("names").to_pylist()), np.uint32).astype(U64)
            wanted = np.sort(np.repeat(shared.column("bucket").to_numpy().astype(U64), sizes) << U64(32) | names)
        owners, ids = table.column("owner").to_numpy(), table.column("doc_id").to_numpy()
        parts = {name: [] for name in ("owner", "doc_id", "at", "n", "key", "name")}
        texts: list[bytes] = []
        for first, data, bounds in _slices(table) if len(wanted) else ():
            runs = Runs(data, bounds)
            bucket, name = _bucket(runs.keys, buckets)
            full = bucket.astype(U64) << U64(32) | name.astype(U64)
            spot = np.minimum(np.searchsorted(wanted, full), len(wanted) - 1)
            hit = np.flatnonzero(wanted[spot] == full)
            at, n, text = runs.at[hit], runs.counts[hit], runs.text[hit]
            raw = data.tobytes()
            parts["owner"].append(owners[first + text])
            parts["doc_id"].append(ids[first + text])
            parts["at"].append(at - bounds[text])
            parts["n"].append(n)
            parts["key"].append(runs.keys[hit].view(np.int64))
            parts["name"].append(runs.names(hit).view(np.int64))
            texts += [raw[a : a + m + LENGTH - 1] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
        columns = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}
        short = {k: pa.array(v, pa.int32() if k in ("at", "n") else pa.int64()) for k, v in columns.items()}
        return pa.table({**short, "bytes": pa.array(texts, pa.binary())})

    return found


def _suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, run and position in the run of all suffixes of some runs."""
    sizes = np.array([len(t) for t in texts])
    names = suffix_names(block_names(np.frombuffer(b"".join(texts), np.uint8)))
    counts = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    return names[(np.cumsum(sizes) - sizes)[run] + place], run, place


def _sort_bucket(keys: np.ndarray, ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Run and position of the suffixes that a smaller id has too, in the same bucket."""
    name, run, place = _suffixes(texts)
    order = np.lexsort((ids[run], name, keys[run]))
    ranked_key, ranked_name, ranked_id = keys[run][order], name[order], ids[run][order]
    head = np.r_[True, (ranked_key[1:] != ranked_key[:-1]) | (ranked_name[1:] != ranked_name[:-1])]
    least = ranked_id[np.flatnonzero(head)][np.cumsum(head) - 1]
    covered = order[ranked_id > least]
    covered.sort()
    return run[covered], place[covered]


_SPAN = "array<struct<low:long,high:long>>"


def _spans(keep: list[pa.Array], names: list[str], run: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Covered suffixes, in order, as spans of suffix positions [low, high) beside columns of each run."""
    new = np.r_[True, (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)] if len(run) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(run)] - 1 if len(starts) else starts
    owner = run[starts]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
    spans = pa.StructArray.from_arrays([pa.array(place[starts]), pa.array(place[ends] + 1)], ["low", "high"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(owner)].astype(np.int32)), spans)
    kept = [column.take(pa.array(owner[first])) for column in keep]
    return pa.RecordBatch.from_arrays([*kept, lists], [*names, "spans"])


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ordered by bucket -> covered spans of suffixes, some whole buckets at a time."""
    carried = ["owner", "at"]
    waiting: list[pa.RecordBatch] = []

    def flush(lot: pa.Table) -> pa.RecordBatch:
        texts = lot.column("bytes").to_pylist()
        found = _sort_bucket(lot.column("key").to_numpy(), lot.column("doc_id").to_numpy(), texts)
        return _spans([lot.column(c).combine_chunks() for c in carried], carried, *found)

    for batch in batches:
        for at in range(0, batch.num_rows, LOT_RUNS):
            waiting.append(batch.slice(at, LOT_RUNS))
            lot = pa.Table.from_batches(waiting)
            keys = lot.column("key").to_numpy()
            whole = int(np.searchsorted(keys == keys[-1], True)) if lot.num_rows >= LOT_RUNS else 0
            if whole:  # the last bucket may go on in the next batch
                yield flush(lot.slice(0, whole))
                waiting = lot.slice(whole).combine_chunks().to_batches()
    if waiting:
        yield flush(pa.Table.from_batches(waiting))


def _all_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, LOT_RUNS):
            part = batch.slice(at, LOT_RUNS)
            suffix, run, place = _suffixes(part.column("bytes").to_pylist())
            columns = [part.column(c).take(pa.array(run)) for c in ("key", "name", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(suffix.view(np.int64)), pa.array(place)], ["key", "name", "doc_id", "suffix", "place"]
            )


def _spread_buckets(runs: DataFrame) -> DataFrame:
    """As ``_sorted_buckets``, by suffix: equal runs and equal suffixes are combined in each task before they meet."""
    firsts = runs.groupBy("key", "name").agg(F.min(F.struct("doc_id", "n", "bytes")).alias("first"))
    firsts = store(firsts.select("key", "name", "first.*"), "distinct")
    suffixes = firsts.select("key", "name", "doc_id", "bytes").mapInArrow(
        _all_suffixes, "key long, name long, doc_id long, suffix long, place long"
    )
    least = suffixes.groupBy("key", "suffix").agg(F.min("doc_id").alias("least"))
    partial = (
        suffixes.join(least, ["key", "suffix"])
        .where("doc_id > least")
        .groupBy("key", "name")
        .agg(F.collect_list(F.struct(F.col("place").alias("low"), (F.col("place") + 1).alias("high"))).alias("spans"))
    )
    known = firsts.select("key", "name", F.col("doc_id").alias("first"), "n").join(partial, ["key", "name"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n").cast("long").alias("high")))
    return (
        runs.select("owner", "at", "doc_id", "key", "name")
        .join(known, ["key", "name"])
        .withColumn("spans", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans")))
        .where("spans IS NOT NULL")
        .select("owner", "at", "spans")
    )


def covered_spans(documents: DataFrame, chunks: int, buckets: int, hot_runs: int) -> DataFrame:
    """Per run with covered suffixes: chunk, owner (its document), and spans of bytes [low, high)."""
    spark = documents.sparkSession
    sampled = documents.groupBy("chunk").applyInArrow(
        _sampled(buckets), "chunk long, bucket long, names binary, several binary"
    )
    shared = store(sampled.groupBy("bucket").applyInArrow(_shared, "chunk long, bucket long, names binary"), "shared")
    release(spark)
    runs = store(
        documents.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_shared_runs(buckets), _RUNS), "runs"
    )
    release(spark)

    keys = store(
        runs.groupBy("key").agg(
            F.min("doc_id").alias("first"),
            F.count("*").alias("size"),
            (F.min("name") != F.max("name")).alias("mixed"),
        ),
        "keys",
    )
    release(spark)
    mixed = store(keys.where("mixed").select("key", (F.col("size") > hot_runs).alias("hot")), "mixed")
    open_runs = runs.join(measured(mixed, MIXED_BROADCAST_ROWS), "key")
    sorted_runs = (
        open_runs.where("NOT hot")
        .select("key", "doc_id", "owner", "at", "bytes")
        .repartition(partitions(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(_sorted_buckets, f"owner long, at int, spans {_SPAN}")
    )
    parts = [store(sorted_runs, "sorted")]
    release(spark)
    if not mixed.where("hot").isEmpty():
        parts.append(store(_spread_buckets(store(open_runs.where("hot"), "hot")), "spread"))
        release(spark)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n").cast("long").alias("high")))
    parts.append(
        runs.select("key", "doc_id", "owner", "at", "n")
        .join(keys.where("NOT mixed").select("key", "first"), "key")
        .where(F.col("doc_id") > F.col("first"))
        .select("owner", "at", whole.alias("spans"))
    )
    spans = F.transform(
        "spans",
        lambda s: F.struct((s["low"] + F.col("at")).alias("low"), (s["high"] + F.col("at") + (LENGTH - 1)).alias("high")),
    )
    covered = reduce(DataFrame.unionByName, parts)
    return covered.select(_chunk(F.col("owner"), chunks), "owner", F.explode(spans).alias("span")).select(
        "chunk", "owner", "span.low", "span.high"
    )


def _chunk(owner: Column, chunks: int) -> Column:
    return F.pmod(owner, F.lit(chunks)).alias("chunk")


def _cut(carried: list[str], with_text: bool, layout: pa.Schema):
    """Chunk and its covered spans -> its documents, cut: with their texts, or with what was found."""

    def cut(key: tuple, table: pa.Table, covered: pa.Table) -> pa.Table:
        starts, ends, spanned = (covered.column(c).to_numpy() for c in ("low", "high", "owner"))
        order = np.argsort(spanned, kind="stable")
        starts, ends, spanned = starts[order], ends[order], spanned[order]
        data, bounds = arrays.text_bytes(table.column("text"))
        owners = table.column("owner").to_numpy()
        first, last = np.searchsorted(spanned, owners), np.searchsorted(spanned, owners, side="right")
        texts = table.column("text").to_pylist() if with_text else []
        facts = []
        for i in range(len(owners)):
            raw = data[bounds[i] : bounds[i + 1]]
            gone = np.zeros(len(raw), bool)
            for low, high in zip(starts[first[i] : last[i]].tolist(), ends[first[i] : last[i]].tolist(), strict=True):
                gone[low:high] = True
            kept = raw[~gone].tobytes()
            if with_text and gone.any():
                texts[i] = kept.decode("utf-8", "ignore")
            if not with_text:
                runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
                facts.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        columns = [table.column(f"own_{i}") for i in range(len(carried))]
        columns += [pa.array(texts)] if with_text else [pa.array(c) for c in zip(*facts, strict=True)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, layout, strict=True)], schema=layout)

    return cut


FOUND = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}


def _remove(documents: DataFrame, carried: list[str], with_text: bool, hot_runs: int, chunk_bytes: int) -> DataFrame:
    spark = documents.sparkSession
    text_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(2 * partitions(spark), text_bytes // chunk_bytes + 1)
    owner = F.xxhash64("doc_id", "text")
    keyed = documents.select(
        _chunk(owner, chunks),
        owner.alias("owner"),
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"),
        "text",
        *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(carried)],
    )
    plain = keyed.select("chunk", "owner", "doc_id", "text")
    covered = store(covered_spans(plain, chunks, partitions(spark), hot_runs), "covered")
    release(spark)
    fields = [T.StructField(c, documents.schema[c].dataType) for c in carried]
    if with_text:
        schema = T.StructType([*fields, T.StructField("text", T.StringType())])
    else:
        schema = T.StructType([*fields, *(T.StructField(c, kind) for c, kind in FOUND.items())])
    cut = _cut(carried, with_text, to_arrow_schema(schema))
    return keyed.groupBy("chunk").cogroup(covered.groupBy("chunk")).applyInArrow(cut, schema)


def remove_repeats(documents: DataFrame, hot_runs: int = HOT_RUNS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents with their texts cut; all columns as they were."""
    carried = [c for c in documents.columns if c != "text"]
    return _remove(documents, carried, True, hot_runs, chunk_bytes).select(*[f"`{c}`" for c in documents.columns])


def digests(documents: DataFrame, hot_runs: int = HOT_RUNS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, and the SHA-256 of the bytes kept."""
    return _remove(documents, ["doc_id"], False, hot_runs, chunk_bytes)
