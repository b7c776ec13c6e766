"""Importance resampling, against a plain version of it."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfscan.llm import importance
from tests.conftest import DATA
from tests.llm.conftest import documents

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text: str | None) -> tuple[int, list[int]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain(rows: list[tuple], target: list) -> list[tuple]:
    own = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for x in own for b in x[2]), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    scored = []
    for i, n, found in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    allowed = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): k for k, x in enumerate(allowed[: 5 * len(allowed) // 100], 1)}
    return [(*x[:4], ranks.get(id(x)), x[4]) for x in scored]


def got(df) -> list[str]:
    return sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"], r["n_words"])) for r in df.collect())


def test_corpus(spark, corpus):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert got(importance.resample(corpus, target)) == sorted(map(str, plain(rows, [r["text"] for r in target.collect()])))


ODD = [
    *[(i, f"some words of the text {i} " * 4) for i in range(60)],
    *[(7, "the same row of more than twenty words, " * 3) for _ in range(40)],
    (None, "no id " * 12),
    (None, None),
    (1, None),
    (2, ""),
    (3, " .,\n-"),
    (4, "Ünï\x7fcode 9 été A-z\x00b \U0001f600x"),
    (5, "é" * 5000 + " tail"),
    (6, " ".join(f"w{i % 900}" for i in range(30_000))),
]


@pytest.mark.parametrize("block,rows", [(1 << 18, 64), (5, 1), (64, 10_000)])
def test_odd_rows(spark, monkeypatch, block, rows):
    """Whatever the blocks, and whether features go through matrices or one by one."""
    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    monkeypatch.setattr(importance, "MATRIX_ROWS", rows)
    for _, n, words, sizes, buckets in importance.bucket_slices(pa.array([t for _, t in ODD])):
        want = [plain_features(t) for _, t in ODD]
        assert words.tolist() == [w for w, _ in want] and sizes.tolist() == [len(f) for _, f in want] and n == len(ODD)
        edges = np.r_[0, np.cumsum(sizes)]
        for k, (_, found) in enumerate(want):
            assert sorted(buckets[edges[k] : edges[k + 1]].tolist()) == sorted(found)
    target = spark.createDataFrame([(1, "the text of words"), (2, None)], "item_id long, text string")
    assert got(importance.resample(documents(spark, *ODD), target)) == sorted(map(str, plain(ODD, ["the text of words"])))


def test_crc_of_many_lengths():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    starts = np.arange(0, 4000, 7)
    lengths = 1 + (starts * 31) % 17
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]
    assert importance.crc32_of(data, starts, lengths).tolist() == want


def test_drawn_documents(spark, corpus):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    ranked = {r["doc_id"] for r in importance.resample(corpus, target).collect() if r["rank"]}
    chosen = importance.drawn(corpus, target)
    assert chosen.columns == corpus.columns and {r["doc_id"] for r in chosen.collect()} == ranked


def test_empty_tables(spark, nothing):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(nothing, target).collect() == []
    rows = [(i, f"a b c {i} " * 8) for i in range(40)]
    assert got(importance.resample(documents(spark, *rows), target)) == sorted(map(str, plain(rows, [])))
