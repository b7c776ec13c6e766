from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from shelfscan.llm import repeats
from tests.llm.conftest import documents

LAST = repeats.LAST_ID


def brute(rows: list[tuple]) -> list[tuple]:
    least: dict[bytes, int] = {}
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, raw in texts:
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            least[s] = min(least.get(s, key), key)
    out = []
    for key, doc_id, raw in texts:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < key:
                gone[p : p + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options) -> list[tuple]:
    return sorted((tuple(r) for r in repeats.digests(df, **options).collect()), key=str)


def test_equals_brute_force(corpus, texts):
    assert found(corpus) == brute(list(texts.items()))


@pytest.mark.parametrize("options", [{}, {"hot_runs": 0}, {"hot_runs": 3, "chunk_bytes": 3000}])
def test_shared_passages(spark, options, monkeypatch):
    monkeypatch.setattr(repeats, "LOT_RUNS", 7)
    source = random.Random(8)
    letters = "abcdeé \n"
    some = lambda n: "".join(source.choice(letters) for _ in range(n))
    passages = [some(n) for n in (40, 49, 50, 51, 70, 120, 300)]
    rows = []
    for i in range(120):
        parts = [some(source.randrange(0, 60)) for _ in range(3)]
        for k in range(2):
            text = source.choice(passages)
            parts.insert(k + 1, text[source.randrange(3) : len(text) - source.randrange(3)])
        rows.append((source.randrange(80), "".join(parts)))
    rows += [(200, "a" * 400), (201, "a" * 300), (202, "ab" * 200), (203, "b" + "a" * 49), (204, "a" * 50), (205, rows[0][1])]
    assert found(documents(spark, *rows), **options) == brute(rows)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 8]
    few = odd.where("doc_id IS NULL OR doc_id <> 8")
    assert found(few) == brute(rows)
    assert found(nothing) == []
    cut = repeats.remove_repeats(odd)
    assert cut.columns == odd.columns
    by_id = {r["doc_id"]: r for r in cut.where("doc_id IN (2, 3, 7, 8)").collect()}
    assert (by_id[2]["text"], by_id[3]["text"], by_id[7]["text"], by_id[8]["text"]) == (None, "", "", "é" * 3000)
    assert by_id[7]["chunk"] == 7 and by_id[7]["kept"] is True


def test_parts_of_characters_are_dropped(spark):
    passage = "0123456789" * 5
    rows = [(1, "é" + passage[:49] + "ü"), (2, "è" + passage[:49] + "ö")]
    assert repeats.remove_repeats(documents(spark, *rows)).orderBy("doc_id").collect()[1]["text"] == "è"
