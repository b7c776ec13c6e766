"""The trie of conversation prefixes, from sorted conversations and range minima over their LCPs.

Conversations are sequences of turns; two turns are equal if role and text are, and stand for
each other as 128-bit hashes that also hold their depth. Spark sorts all sequences by range. In
sorted order a prefix' members are an interval, and neighbours' longest common prefixes (LCPs)
say where it ends: every candidate prefix finds its right end, and every row the left end of the
prefix it shares with the row before, by halving steps over a sparse table of range minima of
the LCPs, each independently of all others. A second table gives the smallest id of an interval.
Candidates come in preorder, so sums over subtrees are differences of running sums.

Sorted rows are worked on in tiles of some ``tile_turns`` turns, whatever the partition. A node is
closed if its interval touches neither end of its tile; then all its figures are final. The open
ones, which are prefixes of the first and the last row of a tile, are merged by the hash of their
prefix, and their subtree sums follow by pointer doubling over the open nodes alone. So a prefix
that a third of all conversations share is split over tiles like any other.

A conversation of more than ``segment`` turns is several rows, each sorted behind the hash of what
comes before, and the nodes on its way to the next segment are open; so one conversation may hold
any share of the turns. Positions of turns come from a sort by range as well.

The list of ids that end at an open node is hashed as a stream of short pieces: its digest needs
them in order, but none of its tasks holds them all.

Nulls: a null role or text is empty, null turns come first. Turns of one number are ordered by the
hash of role and text. Turns without a conversation's id belong to none and are left out. Repeated
rows are turns of their own. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.numbering import dealt_by_range
from shelfscan.llm.storage import BROADCAST_ROWS, partitions, store

SEGMENT = 256
TILE_TURNS = 400_000
PIECE_IDS = 256
BASE_EVERY = 20
HEAD_TURNS = 4  # a head has fewer turns than this
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64

CLOSED, OPEN, PIECE = 0, 1, 2
NO_IDS = hashlib.sha256(b"").hexdigest()


# ---- conversations as rows of segments


def positioned(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored turns (part, place, conv_id, a, b, words), sorted, and per part and conversation: first (place), before, n."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    dealt = dealt_by_range(store(turns, "turns"), ["conv_id", F.asc_nulls_first("turn"), "a", "b", "row"], "positions")
    counts = dealt.groupBy("part", "conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by conv_id order by part rows between unbounded preceding and 1 preceding), 0)")
    return dealt, store(counts.withColumn("before", before), "firsts")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: conv_id, depth (from 0), a, b, words, length (of the conversation).

    A conversation's head, its first h turns, is that of the conversation whose id is the multiple
    of BASE_EVERY below; h is the CRC-32 of its id modulo HEAD_TURNS. Each conversation has one
    more row, without depth, so that none without turns is lost.
    """
    dealt, firsts = positioned(conversations)
    pos = F.col("place") - F.col("first") + F.col("before")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BASE_EVERY))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    heads = (
        dealt.join(firsts, ["part", "conv_id"])
        .withColumn("pos", pos)
        .where((F.pmod("conv_id", F.lit(BASE_EVERY)) == 0) & (F.col("pos") < HEAD_TURNS - 1))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("heads"))  # at most 3
    )
    k = F.least(F.col("h"), F.size(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType))))
    convs = store(
        firsts.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"))
        .withColumns({"base": base, "h": h})
        .join(heads, "base", "left")
        .withColumn("k", k.cast("long"))
        .withColumn("length", F.col("k") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
        .select("conv_id", "h", "k", "length", F.slice("heads", 1, F.col("k").cast("int")).alias("heads")),
        "conversations",
    )
    known = firsts.join(convs.select("conv_id", "h", "k", "length"), "conv_id")
    own = (
        dealt.join(known, ["part", "conv_id"])
        .withColumn("pos", pos)
        .where("pos >= h")
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "words", "length")
    )
    taken = convs.where("k > 0").select("conv_id", F.explode("heads").alias("x"), "length")
    taken = taken.select("conv_id", F.col("x.pos").alias("depth"), "x.a", "x.b", "x.words", "length")
    none = F.lit(None).cast("long")
    every = convs.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("words"), "length")
    return own.unionByName(taken).unionByName(every)


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of up to ``segment`` turns: seg, s0..s3 (what comes before it), keys (two numbers a turn), words, more, conv_id."""
    low, high = F.lit(0xFFFFFFFF), 32
    sums = {}
    for i, x in enumerate("ab"):
        sums[f"s{2 * i}"] = F.col(f"t{x}").bitwiseAND(low)
        sums[f"s{2 * i + 1}"] = F.shiftrightunsigned(f"t{x}", high)
    turn = F.when(F.col("depth").isNotNull(), F.struct("depth", "ta", "tb", "words"))
    rows = store(
        turns.withColumns({"ta": F.xxhash64("a", "depth"), "tb": F.xxhash64("b", "depth")})
        .withColumn("seg", F.coalesce(F.expr(f"depth div {segment}"), F.lit(0)))
        .groupBy("conv_id", "seg")
        .agg(
            F.sort_array(F.collect_list(turn)).alias("turns"),
            F.max("length").alias("length"),
            *[F.sum(F.when(F.col("depth").isNotNull(), v)).alias(name) for name, v in sums.items()],
        )
        .select(
            "conv_id",
            "seg",
            ((F.col("seg") + 1) * segment < F.col("length")).alias("more"),
            F.flatten(F.transform("turns", lambda t: F.array(t["ta"], t["tb"]))).alias("keys"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
            *sums,
        ),
        "segments",
    )
    columns = ["seg", *sums, "keys", "words", "more", "conv_id"]
    first = rows.where("seg = 0").withColumns({s: F.lit(0).cast("long") for s in sums})
    earlier = "over (partition by conv_id order by seg rows between unbounded preceding and 1 preceding)"
    chains = rows.where("more OR seg > 0").select("conv_id", "seg", *[F.expr(f"sum({s}) {earlier}").alias(s) for s in sums])
    later = rows.where("seg > 0").drop(*sums).join(chains.where("seg > 0"), ["conv_id", "seg"])
    return first.select(*columns).unionByName(later.select(*columns))


# ---- the nodes of a tile


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Table k holds the minimum of the 2^k values from each place on."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    return tables


def right_ends(tables: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row up to which all LCPs behind ``row`` are at least ``depth``, by halving steps."""
    at = row.copy()
    for k in reversed(range(len(tables))):
        last = len(tables[k]) - 1
        on = (at + 1 <= last) & (tables[k][np.minimum(at + 1, last)] >= depth)
        at[on] += 1 << k
    return at


def left_ends(tables: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row from which on all LCPs up to that of ``row`` are at least ``depth``."""
    at = row.copy()
    for k in reversed(range(len(tables))):
        start = at - (1 << k) + 1
        on = (start >= 0) & (tables[k][np.clip(start, 0, len(tables[k]) - 1)] >= depth)
        at[on] -= 1 << k
    return at


def range_minimum(tables: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of the values from ``low`` to ``high``, both included, of two overlapping table entries."""
    k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), tables[0].dtype)
    for j in np.unique(k).tolist():
        own = k == j
        out[own] = np.minimum(tables[j][low[own]], tables[j][high[own] - (1 << j) + 1])
    return out


def common_prefixes(new_group: np.ndarray, ta: np.ndarray, tb: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Turns that each row has in common with the row before; -1 if that is of another group or there is none."""
    lengths = np.diff(edges)
    shared = np.r_[0, np.minimum(lengths[1:], lengths[:-1])]
    shared[new_group] = 0
    some = np.flatnonzero(shared)
    counts = shared[some]
    begin = np.cumsum(counts) - counts
    step = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    here, there = np.repeat(edges[some], counts) + step, np.repeat(edges[some - 1], counts) + step
    unequal = (ta[here] != ta[there]) | (tb[here] != tb[there])
    if len(some):
        shared[some] = np.minimum(counts, np.minimum.reduceat(np.where(unequal, step, len(ta)), begin))
    shared[new_group] = -1
    return shared


_FIELDS = [
    ("kind", pa.int32()),
    *[(x, pa.int64()) for x in "depth ka kb pa pb conv_id parent_conv_id n_convs n_children n_leaves saved".split()],
    *[(x, pa.int64()) for x in "ext_leaves ext_saved words".split()],
    ("text", pa.string()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ", ".join(f"{n} {'int' if t == pa.int32() else 'string' if t == pa.string() else 'long'}" for n, t in _FIELDS)


def _rows(n: int, **columns) -> pa.RecordBatch:
    given = {k: pa.array(v, _SCHEMA.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def tile_nodes(tile: pa.Table, segment: int, piece_ids: int) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted rows: closed ones with final figures, open ones with their part of them, and pieces of id lists."""
    tile = tile.combine_chunks()
    n = tile.num_rows
    col = {x: tile.column(x).combine_chunks() if tile.num_rows else tile.column(x) for x in tile.column_names}
    col = {k: (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v) for k, v in col.items()}
    seg, conv, more = col["seg"].to_numpy(), col["conv_id"].to_numpy(), col["more"].to_numpy(zero_copy_only=False)
    s = [col[f"s{i}"].to_numpy() for i in range(4)]
    before_a, before_b = (s[0].astype(U64) + (s[1].astype(U64) << U64(32))), (s[2].astype(U64) + (s[3].astype(U64) << U64(32)))
    keys = col["keys"].flatten().to_numpy().view(U64)
    ta, tb, words = keys[0::2], keys[1::2], col["words"].flatten().to_numpy()
    lengths = col["words"].value_lengths().to_numpy().astype(np.int64)
    edges = np.r_[0, np.cumsum(lengths)]
    fresh = np.ones(n, bool)
    fresh[1:] = (seg[1:] != seg[:-1]) | np.logical_or.reduce([x[1:] != x[:-1] for x in s])
    lcp = common_prefixes(fresh, ta, tb, edges)

    # candidates: the prefixes that no earlier row of the group has, in preorder
    low = np.where((lcp < 0) & (seg > 0), 1, lcp + 1)
    count = np.maximum(lengths - low + 1, 0)
    at = np.r_[0, np.cumsum(count)]  # first candidate of each row
    row = np.repeat(np.arange(n), count)
    depth = np.arange(int(at[-1])) - np.repeat(at[:-1] - low, count)
    tables = sparse_minima(lcp)
    last = right_ends(tables, row, depth)
    n_convs = last - row + 1
    least = range_minimum(sparse_minima(conv), row, last)
    running_more = np.r_[0, np.cumsum(more)]
    is_open = (row == 0) | (last == n - 1) | (running_more[last + 1] > running_more[row])

    # parents: the candidate before in the same row, or the prefix that the row shares with the one before
    parent = np.arange(len(row)) - 1
    top = np.flatnonzero(count)
    joined = top[lcp[top] >= 0]
    first = left_ends(tables, joined, lcp[joined])
    parent[at[joined]] = at[first] + lcp[joined] - low[first]
    outer = at[top[(lcp[top] < 0) | ((lcp[top] == 0) & (seg[top] > 0))]]  # the root, and children of an earlier segment's node
    parent[outer] = -1

    running_a, running_b = np.r_[U64(0), np.cumsum(ta, dtype=U64)], np.r_[U64(0), np.cumsum(tb, dtype=U64)]
    key = lambda r, d: [  # noqa: E731  hashes of whole prefixes
        (b[r] + c[edges[r] + d] - c[edges[r]]).view(np.int64) for b, c in ((before_a, running_a), (before_b, running_b))
    ]
    deep = depth > 0
    last_words = np.zeros(len(row), np.int64)
    last_words[deep] = words[edges[row[deep]] + depth[deep] - 1]

    leaf = ~is_open & (lengths[last] == depth)
    saved = np.where(is_open, 0, (n_convs - 1) * last_words)
    running_saved, running_leaf = np.r_[0, np.cumsum(saved)], np.r_[0, np.cumsum(leaf)]
    own, end = np.arange(len(row)), at[last + 1]
    sub_saved, sub_leaves = running_saved[end] - running_saved[own], running_leaf[end] - running_leaf[own]
    inner = ~is_open & (parent >= 0)
    children = np.bincount(parent[inner], minlength=len(row))

    # ids that end at a node: its first rows, if they have no turns behind it
    same = np.r_[False, (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])]
    run_start = np.flatnonzero(~same)
    run_of = np.cumsum(~same) - 1
    ending_rows = np.add.reduceat((~more).astype(np.int64), run_start) if n else run_start
    ending = np.where(lengths[row] == depth, ending_rows[run_of[row]], 0)

    global_depth = seg[row] * segment + depth
    shut = np.flatnonzero(~is_open)
    texts = [NO_IDS] * len(shut)
    for k in np.flatnonzero(ending[shut]).tolist():
        c = shut[k]
        ids = conv[row[c] : row[c] + ending[c]].tolist()
        texts[k] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    outside = (parent[shut] < 0) | is_open[parent[shut]]
    pa_, pb_ = key(row[shut], np.maximum(depth[shut] - 1, 0))
    yield _rows(
        len(shut),
        kind=np.full(len(shut), CLOSED),
        depth=global_depth[shut],
        conv_id=least[shut],
        pa=pa.array(pa_, mask=~outside),
        pb=pa.array(pb_, mask=~outside),
        parent_conv_id=pa.array(least[parent[shut]], mask=outside),
        n_convs=n_convs[shut],
        n_children=children[shut],
        n_leaves=sub_leaves[shut],
        saved=sub_saved[shut],
        text=texts,
    )
    wide = np.flatnonzero(is_open)
    (ka, kb), (pa_, pb_) = key(row[wide], depth[wide]), key(row[wide], np.maximum(depth[wide] - 1, 0))
    root = global_depth[wide] == 0
    zero = np.zeros(len(wide), np.int64)
    yield _rows(
        len(wide),
        kind=np.full(len(wide), OPEN),
        depth=global_depth[wide],
        ka=ka,
        kb=kb,
        pa=pa.array(pa_, mask=root),
        pb=pa.array(pb_, mask=root),
        conv_id=least[wide],
        n_convs=n_convs[wide],
        n_children=children[wide],
        n_leaves=sub_leaves[wide],
        saved=sub_saved[wide],
        ext_leaves=zero,
        ext_saved=zero,
        words=last_words[wide],
    )
    # what is closed in the subtrees right below a node of an earlier segment belongs to its sums and those above it
    below = np.flatnonzero((parent < 0) & (seg[row] > 0))
    ka, kb = key(row[below], depth[below] - 1)
    zero = np.zeros(len(below), np.int64)
    yield _rows(
        len(below),
        kind=np.full(len(below), OPEN),
        depth=global_depth[below] - 1,
        ka=ka,
        kb=kb,
        n_convs=zero,
        n_children=(~is_open[below]).astype(np.int64),
        n_leaves=zero,
        saved=zero,
        ext_leaves=sub_leaves[below],
        ext_saved=sub_saved[below],
    )
    for c in wide[ending[wide] > 0].tolist():
        ids = conv[row[c] : row[c] + ending[c]].tolist()
        pieces = [ids[i : i + piece_ids] for i in range(0, len(ids), piece_ids)]
        (ka,), (kb,) = key(row[c : c + 1], depth[c : c + 1])
        m = len(pieces)
        yield _rows(
            m,
            kind=[PIECE] * m,
            depth=[int(global_depth[c])] * m,
            ka=[int(ka)] * m,
            kb=[int(kb)] * m,
            conv_id=[p[0] for p in pieces],
            text=[",".join(map(str, p)) for p in pieces],
        )


def nodes_by_tile(rows: DataFrame, segment: int = SEGMENT, tile_turns: int = TILE_TURNS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """The nodes of all tiles, from rows of ``segments``."""
    order = ["seg", "s0", "s1", "s2", "s3", "keys", "more", "conv_id"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            held.append(batch)
            turns += len(batch.column("words").flatten()) + len(batch)
            if turns >= tile_turns:
                yield from tile_nodes(pa.Table.from_batches(held), segment, piece_ids)
                held, turns = [], 0
        if turns:
            yield from tile_nodes(pa.Table.from_batches(held), segment, piece_ids)

    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(found, _DDL)


# ---- open nodes of all tiles


_KEY = ["depth", "ka", "kb"]


def merged(found: DataFrame) -> DataFrame:
    """Stored open nodes, whole: keys, conv_id, n_convs, n_children, and part of the subtree sums."""
    nodes = (
        found.where(F.col("kind") == OPEN)
        .groupBy(*_KEY)
        .agg(
            *[F.max(x).alias(x) for x in ("pa", "pb", "words")],
            F.min("conv_id").alias("conv_id"),
            *[F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved", "ext_leaves", "ext_saved")],
        )
    )
    nodes = store(nodes, "open_nodes")
    children = nodes.where("pa IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    counted = nodes.join(children.agg(F.count("*").alias("more")), _KEY, "left")
    return store(counted.withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "open_nodes")


def with_subtrees(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved of whole subtrees, by pointer doubling.

    After round k a node has the sums of all nodes less than 2^k below it, and knows its ancestor
    2^k above; so the rounds are the logarithm of the depth.
    """
    own_saved = (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0)) + F.col("ext_saved")
    own_leaves = (F.col("n_children") == 0).cast("long") + F.col("ext_leaves")
    sums = nodes.select(*_KEY, F.col("pa").alias("ua"), F.col("pb").alias("ub"), own_saved.alias("s"), own_leaves.alias("l"))
    distance, deepest = 1, nodes.agg(F.max("depth")).first()[0] or 0
    while distance <= deepest:
        up = (F.col("depth") - distance).alias("depth")
        below = (
            sums.where("ua IS NOT NULL").select(up, F.col("ua").alias("ka"), F.col("ub").alias("kb"), "s", "l")
            .groupBy(*_KEY).agg(F.sum("s").alias("more_s"), F.sum("l").alias("more_l"))
        )
        above = sums.select((F.col("depth") + distance).alias("depth"), F.col("ka").alias("ua"), F.col("kb").alias("ub"),
                            F.col("ua").alias("next_a"), F.col("ub").alias("next_b"))
        sums = store(
            sums.join(below, _KEY, "left")
            .join(above, ["depth", "ua", "ub"], "left")
            .select(
                *_KEY,
                F.col("next_a").alias("ua"),
                F.col("next_b").alias("ub"),
                (F.col("s") + F.coalesce("more_s", F.lit(0))).alias("s"),
                (F.col("l") + F.coalesce("more_l", F.lit(0))).alias("l"),
            ),
            "doubled",
        )
        distance *= 2
    return (
        nodes.join(sums.select(*_KEY, "s", "l"), _KEY)
        .withColumns({"n_leaves": F.col("n_leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")})
        .drop("s", "l")
    )


def list_digests(found: DataFrame) -> DataFrame:
    """Per open node at which conversations end: the SHA-256 of their ids, hashed piece by piece."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in (*_KEY, "text")]
            for *key, text in zip(*columns, strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if at is not None:
            out.append((*at, digest.hexdigest()))
        fields = [*zip(*out, strict=True)] if out else [[]] * 4
        types = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(fields, types, strict=True)], [*_KEY, "digest"])

    pieces = found.where(F.col("kind") == PIECE).select(*_KEY, "conv_id", "text")
    dealt = pieces.repartition(partitions(found.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return dealt.mapInArrow(hashed, "depth long, ka long, kb long, digest string")


def _with_parents(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (pa, pb, depth) with found_id, the conv_id of their parents among the stored open ``nodes``.

    Very many rows may share a parent; beyond the size for a broadcast the keys are salted.
    """
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("found_id"))
    if above.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(above), ["depth", "pa", "pb"], "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    copies = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["depth", "pa", "pb", "salt"], "left").drop("salt")


def trie(
    conversations: DataFrame, segment: int = SEGMENT, tile_turns: int = TILE_TURNS, piece_ids: int = PIECE_IDS
) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens sums, over a node's subtree, the words of each node's last text once for every
    member but one: what a run over all members need not read again.
    """
    rows = segments(rebuilt(conversations), segment)
    found = store(nodes_by_tile(rows, segment, tile_turns, piece_ids), "nodes")
    nodes = merged(found)
    final = ["n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")]
    parent = F.coalesce("parent_conv_id", "found_id").alias("parent_conv_id")
    shut = _with_parents(found.where(F.col("kind") == CLOSED), nodes).select(
        "conv_id", "depth", parent, *final, F.col("text").alias("ends_sha256")
    )
    ends = F.coalesce("digest", F.lit(NO_IDS)).alias("ends_sha256")
    wide = _with_parents(with_subtrees(nodes).join(list_digests(found), _KEY, "left"), nodes).select(
        "conv_id", "depth", F.col("found_id").alias("parent_conv_id"), *final, ends
    )
    return shut.unionByName(wide)
