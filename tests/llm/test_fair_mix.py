"""Weighted fair queueing, against a plain version of it."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from shelfscan.llm import fair_mix
from tests.llm.conftest import LAYOUT


def plain_targets(sizes: dict, weights, budget: float, passes: int) -> dict:
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full: set = set()
    while True:
        rest = [n for n in names if n not in full]
        level = (budget - sum(passes * sizes[n] for n in full)) / sum(weight[n] for n in rest) if rest else 0
        more = {n for n in rest if level * weight[n] > passes * sizes[n]}
        if not more:
            return {n: float(passes * sizes[n]) if n in full else level * weight[n] for n in names}
        full |= more


def plain_mix(rows: list[tuple], weights=(5, 2, 1), share=150, passes=2) -> list[tuple]:
    """(doc_id, size, source size, target, taken, source) of (doc_id, text, source)."""
    found, sizes = [], Counter()
    for i, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        code = hashlib.sha256(f"mix:{'' if i is None else i}:{text or ''}".encode()).hexdigest()[:32]
        found.append((source, code, i, n))
        sizes[source] += n
    target = plain_targets(sizes, weights, share * sum(sizes.values()) / 100, passes)
    out, before = [], defaultdict(int)
    for source, _, i, n in sorted(found, key=lambda x: x[1]):
        starts = [p * sizes[source] + before[source] for p in range(passes)]
        taken = sum(max(0, min(n, floor(target[source]) - start)) for start in starts)
        out.append((i, n, sizes[source], target[source], taken, source))
        before[source] += n
    return out


def got(df) -> list[str]:
    return sorted(str((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["source"])) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, "x") for i, t, s in rows], "doc_id long, text string, source string, lang string, size int, code string")


ODD = [
    (1, "a b c d", "x"),
    (1, "a b c d", "x"),
    (2, None, "x"),
    (None, "one two", None),
    (None, None, None),
    (None, "three four five", ""),
    (3, "", "empty"),
    (4, " \n ", "empty"),
    (5, "w " * 20_000, "é"),
    *[(100 + i, "few words here", "hot") for i in range(300)],
    *[(7, "same row", "hot") for _ in range(2000)],
]


def test_bins_and_lots(spark, monkeypatch):
    monkeypatch.setattr(fair_mix, "BIN_ROWS", 4)
    monkeypatch.setattr(fair_mix, "BINS_IN_LOT", 4)
    monkeypatch.setattr(fair_mix, "COPIES_IN_LOT", 7)
    assert got(fair_mix.mix(frame(spark, ODD))) == sorted(str(x) for x in plain_mix(ODD))


@pytest.mark.parametrize("weights,share,passes,parts", [((1, 9), 250, 3, 13), ((5, 2, 1), 20, 2, 1)])
def test_other_shares_and_partitions(spark, corpus, weights, share, passes, parts):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in corpus.collect()]
    df = fair_mix.mix(corpus.repartition(parts), weights, share, passes).cache()
    assert got(df) == sorted(str(x) for x in plain_mix(rows, weights, share, passes))
    sums = df.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(0 <= r["target"] - r["taken"] < 1 for r in sums)


def test_budget_ends_the_mix(spark, corpus):
    """With a budget below the targets the mix is the beginning of the full one."""
    queued, budget = fair_mix._queues(corpus, (5, 2, 1), 150, 2, "mix")
    every = fair_mix.schedule(queued, budget).orderBy("position").collect()
    part = fair_mix.schedule(queued, budget / 3).orderBy("position").collect()
    assert sum(r["words"] for r in part) == int(budget / 3)
    assert [r["code"] for r in part] == [r["code"] for r in every][: len(part)]
    assert [r["position"] for r in every] == list(range(1, len(every) + 1))
    assert [r["finish"] for r in every] == sorted(r["finish"] for r in every)
    # at any point of the mix each source has had its share, but for the document that is being served
    target = {r["source_no"]: r["target"] for r in queued.collect()}
    largest = queued.agg(F.max("size")).first()[0]
    had = Counter()
    for r in part:
        had[r["source_no"]] += r["words"]
    end = part[-1]["finish"]
    assert all(abs(had[s] - t * end) <= largest + 1 for s, t in target.items())


def test_mixed_texts(spark):
    rows = [(1, "a b", "x"), (2, "c", "x"), (3, None, "y"), (3, "d e f", "y")]
    mixed = fair_mix.mixed(frame(spark, rows)).collect()
    assert [r["position"] for r in mixed] == list(range(1, len(mixed) + 1))
    taken = Counter()
    for r in mixed:
        taken[r["doc_id"], r["text"]] += r["words"]
    want = {(i, t): x[4] for (i, t, _), x in zip(rows, sorted(plain_mix(rows), key=lambda x: (x[0], x[1])), strict=True) if x[4]}
    assert taken == want


def test_empty_table(spark, nothing):
    empty = nothing.withColumn("source", F.lit("s"))
    assert "doc_id" in LAYOUT and fair_mix.mix(empty).collect() == []


def test_native(spark, corpus):
    plan = fair_mix.mix(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
