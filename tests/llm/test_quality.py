from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from shelfscan.llm import quality
from tests.conftest import DATA

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def counted(df) -> list[tuple]:
    return [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df]


def test_counts_equal_brute_force(spark, corpus, texts):
    for r in quality.judge(corpus, None).collect():
        assert counted([r]) == [brute(texts[r["doc_id"]])]
        assert r["kept"] == (not r["base_failed"])


def test_odd_rows(odd, nothing):
    found = quality.judge(odd, None).collect()
    assert sorted(counted(found)) == sorted(brute(r["text"]) for r in odd.collect())
    assert quality.judge(nothing, None).collect() == []


def test_repeats_and_symbols(spark):
    line = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, f"{line}\n{line}\nx\n \n \n{line} # * $"), (2, "z " * 40)], "doc_id long, text string")
    for r in quality.judge(df, None).collect():
        assert counted([r]) == [brute({1: f"{line}\n{line}\nx\n \n \n{line} # * $", 2: "z " * 40}[r["doc_id"]])]


def test_trees_are_monotone_and_flat():
    random = np.random.default_rng(1)
    x = random.random((3000, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.2 * random.normal(size=3000)) < 0.6).astype(float)
    forest = quality.grow(x, y, [-1, 0, 1], trees=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    for j, sign in ((0, -1), (2, 1)):
        grid = np.repeat(random.random((200, 1, 3)), 50, axis=1)
        grid[:, :, j] = np.linspace(0, 1, 50)
        steps = np.diff(forest.score(grid.reshape(-1, 3)).reshape(200, 50), axis=1)
        assert (sign * steps >= -1e-12).all()

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.limit[node] else forest.right[node]
        return forest.value[node]

    z = [forest.bias + sum(walk(row, root) for root in forest.roots) for row in x[:50]]
    assert np.allclose(1 / (1 + np.exp(-np.array(z))), forest.score(x[:50]))


def test_learns_quality(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = quality.quality(spark.read.parquet(f"{data}/documents.parquet"), labels).join(labels, "doc_id")
    held_out = found.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 AND NOT base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in held_out]) > 0.9


def test_without_labels(spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(corpus, labels) is None
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality.train(corpus, one_kind) is None


@pytest.mark.parametrize("column", ["n_words", "kept"])
def test_clashing_columns(spark, column):
    df = spark.createDataFrame([(1, "a b", 9)], f"doc_id long, text string, {column} long")
    assert quality.judge(df, None).first()["n_words"] == 2
