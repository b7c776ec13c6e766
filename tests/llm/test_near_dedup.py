from __future__ import annotations

import random
import re

import pytest

from shelfscan.llm import near_dedup
from shelfscan.llm.components import components
from tests.llm.conftest import documents

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, words: int) -> frozenset:
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows: list[tuple], words: int, percent: int) -> list[tuple]:
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    ids = [near_dedup.LAST_ID if i is None else i for i, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    out = []
    for i in range(len(rows)):
        first = least[root(i)]
        out.append((rows[i][0], len(sets[i]), None if first == near_dedup.LAST_ID else first, ids[i] == first))
    return sorted(out, key=str)


def found(df, words, percent):
    return sorted((tuple(r)[:4] for r in near_dedup.near_duplicates(df, words, percent).collect()), key=str)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(corpus, texts, words, percent):
    assert found(corpus, words, percent) == brute(list(texts.items()), words, percent)


def edited(words: list[str], changes: int, source: random.Random) -> str:
    out = list(words)
    for at in source.sample(range(len(out)), changes):
        out[at] = f"new{source.random()}"
    return " ".join(out)


def test_groups_of_near_copies(spark, monkeypatch):
    source = random.Random(3)
    rows = []
    for group in range(6):
        base = [f"w{group}x{source.randrange(10**6)}" for _ in range(90)]
        rows += [(len(rows) + i, edited(base, source.randrange(0, 4), source)) for i in range(40)]
    source.shuffle(rows)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:30])]
    expected = brute(rows, 3, 85)
    assert len({r[2] for r in expected}) < len(rows) / 2
    assert found(documents(spark, *rows), 3, 85) == expected
    monkeypatch.setattr(near_dedup, "CENTRE_MEMBERS", 1)
    assert found(documents(spark, *rows), 3, 85) == expected


@pytest.fixture
def compared(monkeypatch):
    """How many pairs were compared."""
    counts, plain = [], near_dedup.store

    def counted(df, label):
        out = plain(df, label)
        if label == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "store", counted)
    return counts


def test_pairs_below_the_threshold_grow_with_members(spark, compared):
    """Copies that each changed other words are alike below the threshold; few of their pairs are looked at."""
    per_member = []
    for members in (60, 240):
        source = random.Random(members)
        base = [f"w{source.randrange(10**6)}" for _ in range(400)]
        rows = [(i, edited(base, 14, source)) for i in range(members)]
        expected = brute(rows, 3, 85)
        assert len({r[2] for r in expected}) > members * 0.9
        compared.clear()
        assert found(documents(spark, *rows), 3, 85) == expected
        per_member.append(sum(compared) / members)
    assert per_member[1] <= max(3, 2 * per_member[0])  # all pairs: 30 and 120 a member


@pytest.mark.parametrize("changes", [(9, 14), (2, 11, 30)])
def test_groups_around_the_threshold(spark, changes):
    """Also several groups that meet in some buckets, and members far from what most have."""
    source = random.Random(sum(changes))
    base = [f"w{source.randrange(10**6)}" for _ in range(300)]
    other = [*base[:200], *[f"v{source.randrange(10**6)}" for _ in range(100)]]
    rows = []
    for text in (base, other):
        rows += [(len(rows) + i, edited(text, source.choice(changes), source)) for i in range(70)]
    rows += [(len(rows) + i, " ".join(base[i : 250 + i])) for i in range(0, 50, 5)]
    expected = brute(rows, 3, 85)
    assert found(documents(spark, *rows), 3, 85) == expected


def test_near_copies_without_ids(spark):
    """Rows are told apart by their texts, so none of them meets all others, and one of a group stays."""
    source = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(None, edited(base, source.randrange(0, 3), source)) for _ in range(60)] + [(None, " ".join(base))] * 30
    rows += [(None, f"other text number {i} of its own words{i}") for i in range(40)] + [(None, None), (None, ""), (None, " ")]
    df = documents(spark, *rows)
    assert found(df, 3, 85) == brute(rows, 3, 85)
    kept = [r["text"] for r in near_dedup.drop_near_duplicates(df, 3, 85).collect()]
    assert sum(t is not None and "w50" in t for t in kept) == 1
    assert sum(t is not None and "other text" in t for t in kept) == 40
    assert sorted(t for t in kept if not (t or "").strip() and t is not None) == ["", " "] and None in kept


def test_chain_of_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(30 - k, " ".join([*[f"n{i}" for i in range(k)], *words[k:]])) for k in range(30)]
    assert found(documents(spark, *rows), 3, 85) == brute(rows, 3, 85)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, 3, 85) == brute(rows, 3, 85)
    assert found(nothing, 3, 85) == []
    kept = near_dedup.drop_near_duplicates(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id IS NOT NULL").collect() if r["text"]) == sorted(
        (i, t) for i, t in rows if t and i not in (None, 7, 9)
    )


def test_components(spark):
    source = random.Random(4)
    nodes = list(range(-50, 150))
    links = [(source.choice(nodes), source.choice(nodes)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)]
    links += [(5000, 5000 + i) for i in range(1, 300)]
    label = {n: n for pair in links for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if any(n in p and p[0] != p[1] for p in links)}
