"""Concatenate and cut: documents as tokens in one long row, cut into sequences of equal length.

First pass: documents are tokenized and stored with their place inside their task's output. The
token totals of the tasks, one number each, give every task's offset by a prefix sum. Second
pass: with its global offset each document knows which windows it reaches into and is cut at
their borders. Only the last sequence is padded. The stored first pass fixes the order, so a
lost executor changes nothing.

Nulls: a null text is empty; each document ends with one id, so an empty one has that alone. A
null or repeated doc_id is kept as it is. An empty table has no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfscan.llm import chunks, storage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE_TOKENS = 2048
END_ID = 1
MARKS = ".,"


@lru_cache(maxsize=2)
def _cache(path: str) -> chunks.IdCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
    tokenizer = Tokenizer.from_file(path)

    marks = {mark: tokenizer.encode(mark, add_special_tokens=False).ids for mark in MARKS}

    def encode(texts: list[str]) -> list[list[int]]:
        """A mark behind a letter is always encoded by itself, so a word is encoded once for all marks behind it."""
        plain = [t[:-1] if len(t) > 1 and t[-1] in marks and t[-2].isalpha() else t for t in texts]
        distinct = list(dict.fromkeys(plain))
        known: dict[str, list[int]] = {}
        for at in range(0, len(distinct), 4096):
            lot = distinct[at : at + 4096]
            found = tokenizer.encode_batch_fast(lot, add_special_tokens=False)
            known.update(zip(lot, [x.ids for x in found], strict=True))
        return [known[p] if p is t else known[p] + marks[t[-1]] for p, t in zip(plain, texts, strict=True)]

    return chunks.IdCache(encode)


def token_blobs(texts: pa.Array, path: str, end_id: int) -> list[bytes]:
    """Each text's ids and the end id, as little-endian unsigned 32-bit numbers."""
    words, heads, codes, cuts = chunks.split_texts(texts)
    cache = _cache(path)
    starts, counts = cache.look_up(words)
    head_ids = cache.encode(heads)
    head_counts = np.array([len(ids) for ids in head_ids], np.int64)
    flat = np.concatenate([cache.ids, *(np.asarray(ids, np.uint32) for ids in head_ids)]).astype("<u4")
    starts = np.r_[starts, len(cache.ids) + np.cumsum(head_counts) - head_counts]
    lengths = np.r_[counts, head_counts][codes]
    ends = np.cumsum(lengths)
    ids = flat[np.arange(int(lengths.sum())) + np.repeat(starts[codes] - (ends - lengths), lengths)]
    borders = np.r_[0, ends][cuts]
    end = np.array([end_id], "<u4").tobytes()
    return [ids[a:b].tobytes() + end for a, b in zip(borders[:-1], borders[1:], strict=True)]


def tokenize(documents: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Per document: part (the task that wrote it), place (tokens before it there), doc_id, n, ids."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in chunks.text_slices(batch.column("text")):
                blobs = token_blobs(texts, tokenizer, end_id)
                sizes = np.array([len(b) // 4 for b in blobs], np.int64)
                ends = place + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(blobs), part, np.int64)),
                        pa.array(ends - sizes),
                        batch.column("doc_id").slice(done, len(blobs)),
                        pa.array(sizes),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["part", "place", "doc_id", "n", "ids"],
                )
                done, place = done + len(blobs), int(ends[-1])

    return documents.select("doc_id", "text").mapInArrow(tokenized, "part long, place long, doc_id long, n long, ids binary")


def pack(documents: DataFrame, size: int = SEQUENCE_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids (binary)."""
    stored = storage.store(tokenize(documents, tokenizer, end_id), "tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        stored.groupBy("part")
        .agg(F.sum("n").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    )
    begin = F.col("base") + F.col("place")
    windows = F.expr(f"sequence(begin div {size}, (begin + n - 1) div {size})")

    def piece(window):
        start = F.greatest(window * size - F.col("begin"), F.lit(0))
        length = F.least((window + 1) * size - F.col("begin"), F.col("n")) - start
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(
            start.alias("start"),
            length.alias("length"),
            window.alias("sequence_id"),
            (F.col("begin") + start - window * size).alias("offset"),
            ids.alias("ids"),
        )

    return (
        stored.join(storage.measured(bases), "part")
        .withColumn("begin", begin)
        .select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("piece"))
        .select("doc_id", "piece.start", "piece.length", "doc_tokens", "piece.sequence_id", "piece.offset", "piece.ids")
    )


def piece_digests(documents: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pack(documents, size).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
