from __future__ import annotations

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfscan.llm import order_minhash as om
from shelfscan.llm import queries
from tests.llm.conftest import documents

SEED = 42  # of the engine's 64-bit hash


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashed(*values) -> int:
    seed = SEED
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<q" if abs(v) >> 31 or getattr(v, "wide", False) else "<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def hashed_longs(*values) -> int:
    seed = SEED
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def brute(text: str | None) -> list[int]:
    """The method in plain steps: number the k-mers, deal them out, pick, order, hash."""
    if not text:
        return []
    words = text.split(" ")
    seen: dict[int, int] = {}
    ranked = []
    for i, word in enumerate(words):
        h = hashed(word, words[i + 1] if i + 1 < len(words) else None)
        n = seen.get(h, 0)
        seen[h] = n + 1
        code = h if n == 0 else signed(xxhash.xxh64_intdigest(struct.pack("<i", n), xxhash.xxh64_intdigest(struct.pack("<q", h), SEED)))
        ranked.append((code, i))
    ranked.sort()
    bins: dict[int, int] = {}
    for j, (code, _) in enumerate(ranked):
        bins.setdefault((code % (1 << 64)) >> (64 - om.BIN_BITS), j)
    out = []
    for b in sorted(bins):
        picked = sorted((ranked[(bins[b] + d) % len(ranked)] for d in range(om.PICKED)), key=lambda x: x[1])
        codes = [c for c, _ in picked]
        mask = (1 << (om.ENTRY_BITS - om.BIN_BITS)) - 1
        out.append(((hashed_longs(*codes) & mask) << om.BIN_BITS) + b)
    return out


def brute_likeness(a: list[int], b: list[int]) -> float:
    filled = {x % om.BINS for x in a} | {x % om.BINS for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


def as_text(entries: list[int]) -> str:
    return "".join(f"{x:08X}" for x in entries)


def test_fingerprints_equal_brute_force(spark):
    texts = ["", None, "a", "a b", " a  b ", "x " * 500, "the cat sat on the mat and the cat sat", "é ü\nß", "w" * 5000,
             " ".join(f"w{i % 37}" for i in range(3000))]
    df = documents(spark, *enumerate(texts))
    got = {r["doc_id"]: r["fingerprint"] for r in om.fingerprints(df).collect()}
    assert got == {i: as_text(brute(t)) for i, t in enumerate(texts)}


def in_turn(rows: list[tuple]) -> list[tuple]:
    """Documents by descending id, null ids last, each with the text after it."""
    coded = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1] or "")), reverse=True)
    return [(i, t or "", coded[(k + 1) % len(coded)][1] or "") for k, (i, t) in enumerate(coded)]


def expected(rows: list[tuple]) -> list[tuple]:
    out = []
    for i, text, after in in_turn(rows):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = brute(text), brute(edited), brute(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other),
                    brute_likeness(own, other), brute_likeness(own, following)))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in om.compare_edited(df).collect()), key=str)


def test_whole_table(corpus, texts):
    got = found(corpus.repartition(6))
    assert got == expected(list(texts.items()))
    assert sum(r[5] for r in got) / len(got) > 0.2 > 0.05 > sum(r[6] for r in got) / len(got)


def test_odd_rows(spark, odd, nothing):
    few = odd.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    assert found(few) == expected([(r["doc_id"], r["text"]) for r in few.collect()])
    assert found(nothing) == []
    alone = documents(spark, (7, "one two three four five six"))
    assert found(alone) == expected([(7, "one two three four five six")])
    assert found(documents(spark, (None, "a"), (None, "b c"))) == expected([(None, "a"), (None, "b c")])
    assert len(found(odd)) == odd.count()


def test_order_counts_in_short_texts(spark):
    """A bin of one k-mer has no order of its own; filled up from the next bins it has."""
    source = random.Random(5)
    rows = []
    for n in (30, 60, 400):
        for _ in range(30):
            words = [f"w{source.randrange(10**6)}" for _ in range(n)]
            rows.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    like = df.groupBy("n").agg(F.avg(om.likeness(om.signature(F.col("a")), om.signature(F.col("b")))).alias("x")).collect()
    like = {r["n"]: r["x"] for r in like}
    assert all(0.25 < x < 0.65 for x in like.values())  # two of a pair are in the same half as often as not


def test_order_counts(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = [words[i ^ 1] for i in range(400)]
    moved = words[200:] + words[:200]
    df = documents(spark, (1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(moved)), (4, " ".join(words)))
    entries = {r[0]: r[1] for r in df.select("doc_id", om.signature(F.col("text"))).collect()}
    assert entries[1] == entries[4]
    assert brute_likeness(entries[1], entries[2]) < 0.1
    assert 0.3 < brute_likeness(entries[1], entries[3]) < 0.8  # the same k-mers, but pairs change places


def test_texts_without_spaces_stay_alike_after_an_edit(spark, tmp_path):
    chance = random.Random(1)
    signs = {"han": [chr(0x4E00 + i) for i in range(2000)], "emoji": [chr(0x1F300 + i) for i in range(300)], "token": list("abcdefgh0123456789"),
             "lines": [f"w{i}\n" for i in range(900)], "tabs": [f"w{i}\t" for i in range(900)]}
    docs = [(i, "".join(chance.choices(kind, k=3000))) for i, kind in enumerate(k for k in signs.values() for _ in range(2))]
    documents(spark, *docs, (100, " \n\t "), (101, "a\tb \n c")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_order_minhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs) + 2 and got[100]["fingerprint"] == ""
    for i, _ in docs:
        assert 0.1 < got[i]["near_edited"] < 0.9 and got[i]["near_next"] < 0.2, (i, got[i]["near_edited"], got[i]["near_next"])


def test_words_or_pieces(spark):
    df = documents(spark, (1, " a  b\u3000c\u00a0d\r\n"), (2, "x " + "y" * 32 + " z"), (3, "x " + "\U0001f300" * 32 + "y z"))
    got = {r[0]: r[1] for r in df.select("doc_id", om.words_or_pieces(F.col("text"))).collect()}
    assert got[1] == ["a", "b", "c", "d"] and got[2] == ["x", "y" * 32, "z"]
    sign = "\U0001f300"
    assert got[3] == ["x", *[sign * 3] * 30, sign * 2 + "y", sign + "y", "y", "z"]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_occurrences(spark, n):
    df = spark.sql(f"SELECT sort_array(transform(sequence(1, {n}), i -> named_struct('h', CAST(i % 3 AS BIGINT), 'i', i))) AS s")
    got = df.select(F.transform("s", lambda x, j: om._occurrence(F.col("s"), x, j))).first()[0]
    rows = sorted((i % 3, i) for i in range(1, n + 1))
    assert got == [sum(h == rows[j][0] for h, _ in rows[:j]) for j in range(n)]


def test_main_path_is_native(spark, corpus):
    plan = om.compare_edited(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.replace("Exchange SinglePartition, ENSURE", "", 2)
