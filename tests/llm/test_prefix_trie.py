"""The prefix trie, against a plain version of it."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from shelfscan.llm import prefix_trie
from tests.conftest import DATA

LAYOUT = "conv_id long, turn long, role string, text string, depth string, words int"


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = [xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))]
            tie = [t - (1 << 64) if t >> 63 else t for t in tie]
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(found, key=lambda x: x[:3])] for c, found in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        sequence = turns.get(c - c % 20, [])[:h] + turns[c][h:]
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
        ends[tuple(sequence)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own_members) - 1) * words
            leaves[node[:d]] += children[node] == 0
    return [
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    ]


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def got(df) -> list[str]:
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], LAYOUT)


def made(seed: int, convs: int, longest: int, kinds: int) -> list[tuple]:
    """Conversations over few different turns, so that many share prefixes."""
    r = np.random.default_rng(seed)
    out = []
    for c in r.choice(convs * 3, convs, replace=False).tolist():
        for t in range(int(r.integers(0, longest + 1))):
            k = int(r.integers(0, kinds))
            out.append((c, t, "user" if k % 2 else None, None if k == 0 else f"turn {k} " * (k % 3)))
    return out


ODD = [
    (0, 0, "user", "first of the base"),
    (0, 1, "bot", "second"),
    (0, 2, "user", None),
    (0, None, None, "before all"),
    (1, 5, "user", "only one"),
    (1, 5, "user", "tied"),
    (1, 5, "user", "tied"),
    (2, 0, "user", "a"),
    (3, 0, None, None),
    (21, 0, "user", "no base here"),
    (21, 1, "user", "b"),
    (21, 2, "user", "c"),
    (21, 3, "user", "d"),
    (None, 0, "user", "no conversation"),
    *[(c, t, "user", f"copy {t}") for c in range(100, 180) for t in range(5)],
    *[(200, t, "user", f"long {t % 7}") for t in range(600)],
    *[(201, t, "user", f"long {t % 7}") for t in range(580)],
    *[(202, t, "user", f"long {t % 7}") for t in range(580)],
    *[(300, 1, "user", "same row")] * 50,
]


@pytest.mark.parametrize("sizes", [{}, {"segment": 2, "tile_turns": 9, "piece_ids": 3}])
def test_odd_rows(spark, sizes):
    assert got(prefix_trie.trie(frame(spark, ODD), **sizes)) == sorted(map(str, plain(ODD)))


@pytest.mark.parametrize(
    "kind,sizes",
    [
        ((1, 300, 6, 2), {"segment": 3, "tile_turns": 20, "piece_ids": 2}),
        ((2, 200, 12, 3), {"segment": 1, "tile_turns": 1}),
        ((3, 40, 30, 1), {"segment": 7, "tile_turns": 60}),
    ],
)
def test_shared_prefixes(spark, kind, sizes):
    """Nodes that cross segments and tiles of any size."""
    rows = made(*kind)
    assert got(prefix_trie.trie(frame(spark, rows).repartition(5), **sizes)) == sorted(map(str, plain(rows)))


def test_table(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)  # parents by the salted join
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.trie(table)) == sorted(map(str, plain(rows)))


def test_ends_by_range_minima():
    values = np.array([-1, 2, 3, 0, 4, 4, 1])
    tables = prefix_trie.sparse_minima(values)
    for row in range(len(values)):
        for depth in range(5):
            right = row
            while right + 1 < len(values) and values[right + 1] >= depth:
                right += 1
            left = row
            while left >= 0 and values[left] >= depth:
                left -= 1
            assert prefix_trie.right_ends(tables, np.array([row]), np.array([depth])).tolist() == [right]
            assert prefix_trie.left_ends(tables, np.array([row]), np.array([depth])).tolist() == [left]
            low, high = np.array([row]), np.array([right])
            assert prefix_trie.range_minimum(tables, low, high).tolist() == [min(values[row : right + 1])]


def test_empty_table(spark):
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    assert prefix_trie.trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
