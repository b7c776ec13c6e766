from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfscan.llm import packing
from tests.llm.conftest import documents

PLAIN = Tokenizer.from_file(packing.TOKENIZER)


def ids_of(text: str | None) -> list[int]:
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(df, rows: list[tuple], size: int) -> None:
    pieces = packing.pack(df, size).collect()
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = 0
    for number, own in sorted(by_sequence.items()):
        own.sort(key=lambda p: p["offset"])
        place = 0
        for p in own:
            assert p["offset"] == place and p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
            place += p["length"]
        assert place == size or number == len(by_sequence) - 1 and place <= size
        total += place
    expected = sorted([(i, ids_of(t)) for i, t in rows], key=str)
    assert total == sum(len(ids) for _, ids in expected)
    # in the order of the row, pieces join to the documents
    line = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    joined, current = [], None
    for p in line:
        if p["start"] == 0:
            current = (p["doc_id"], p["doc_tokens"], [])
            joined.append(current)
        assert current[0] == p["doc_id"] and len(current[2]) == p["start"]
        current[2].extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert all(n == len(ids) for _, n, ids in joined)
    assert sorted([(i, ids) for i, _, ids in joined], key=str) == expected


def test_documents(corpus, texts):
    check(corpus.repartition(5), list(texts.items()), packing.SEQUENCE_TOKENS)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_odd_rows(odd, size):
    few = odd.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    check(few, [(r["doc_id"], r["text"]) for r in few.collect()], size)


def test_long_text_and_nothing(odd, nothing):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()], 2048)
    assert packing.pack(nothing).collect() == []


def test_digests(spark):
    df = documents(spark, (1, "a b  c\n\n d"), (2, " lead"), (3, "trail "))
    for r in packing.piece_digests(df).collect():
        ids = ids_of({1: "a b  c\n\n d", 2: " lead", 3: "trail "}[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == r["length"] == len(ids)
