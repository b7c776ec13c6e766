"""Quality verdict: gradient-boosted trees over document statistics.

Statistics of whole texts are counted on the UTF-8 bytes by whole-array operations. Trees are
grown from histograms of a bounded sample of labelled documents. On chosen statistics (junk
symbols, repeated lines, repeated words) they are monotone: more of it never raises the score.
All trees are flattened into arrays of nodes and a batch of documents walks them together.

Nulls: a null text has no words and fails the base rule; a null doc_id is kept as a value.
Repeated rows are judged each. Without labels of both kinds the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm import arrays
from shelfscan.llm.sample import labelled_sample, one_text_each

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SAMPLE_ROWS = 10_000
THRESHOLD = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees read, and the direction in which each may move the score (0: any).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "words_per_line": 0,
}

_SYMBOL = arrays.byte_table(b"#*$%&|<>")
_UPPER = arrays.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = arrays.byte_table(b"0123456789")
_MARK = arrays.byte_table(b".,;:!?")
_IN_LINE = ~arrays.byte_table(b"\n")


def _earlier_equal(text: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the same code occurs earlier in the same text."""
    order = np.lexsort((np.arange(len(codes)), codes, text))
    same = (text[order][1:] == text[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    out = np.zeros(len(codes), bool)
    out[order[1:][same]] = True
    return out


def _repeated(text: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that its text has twice or more."""
    n = len(codes) - WINDOW + 1
    covered = np.zeros(len(codes), bool)
    if n <= 0:
        return covered
    whole = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    owner, key = text[whole], arrays.window_hash(codes, WINDOW)[whole]
    order = np.lexsort((key, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = whole[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else order
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def statistics(column) -> dict[str, np.ndarray]:
    """Counts and features of each text of an Arrow column."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in [*COUNTS, *FEATURES]}
    for _, data, bounds in arrays.text_slices(column):
        n = len(bounds) - 1

        def total(flags: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][bounds])

        in_word = ~arrays.IS_SEPARATOR[data]
        starts, ends, text = arrays.spans(in_word, bounds)
        codes = arrays.span_hash(data, starts, ends)
        words = np.bincount(text, minlength=n)
        line_starts, line_ends, line_text = arrays.spans(_IN_LINE[data], bounds)
        before = np.r_[0, np.cumsum(in_word)]
        filled = before[line_ends] > before[line_starts]
        line_starts, line_ends, line_text = line_starts[filled], line_ends[filled], line_text[filled]
        dup = _earlier_equal(line_text, arrays.span_hash(data, line_starts, line_ends))
        found = {
            "n_words": words,
            "word_chars": total(in_word & ~arrays.IS_CONTINUATION[data]),
            "n_symbols": total(_SYMBOL[data]),
            "n_dup_lines": np.bincount(line_text[dup], minlength=n),
            "n_repeat_words": np.bincount(text[_repeated(text, codes)], minlength=n),
        }
        lines = np.maximum(np.bincount(line_text, minlength=n), 1)
        some, chars = np.maximum(words, 1), np.maximum(found["word_chars"], 1)
        found |= {
            "log_words": np.log1p(words),
            "word_length": found["word_chars"] / some,
            "symbols_per_word": found["n_symbols"] / some,
            "dup_line_share": found["n_dup_lines"] / lines,
            "repeat_share": found["n_repeat_words"] / some,
            "distinct_share": np.bincount(arrays.distinct(text, codes)[0], minlength=n) / some,
            "upper_share": total(_UPPER[data]) / chars,
            "digit_share": total(_DIGIT[data]) / chars,
            "mark_share": total(_MARK[data]) / some,
            "words_per_line": np.log1p(words / lines),
        }
        for name, values in found.items():
            parts[name].append(values)
    return {
        name: np.concatenate(values).astype(np.int64 if name in COUNTS else float) if values else np.zeros(0)
        for name, values in parts.items()
    }


@dataclass(frozen=True)
class Forest:
    """Flattened trees: node i goes to ``left[i]`` if its feature is at most ``limit[i]``, else to
    ``right[i]``; a leaf leads to itself and adds ``value[i]``. ``roots`` has one node per tree."""

    bias: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of the rows of ``x``."""
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            z += self.value[node]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    leaf_rows: int = 5,
    ridge: float = 1.0,
) -> Forest:
    """Boost trees on the logistic loss with Newton steps, splitting at histogram edges.

    A split on a monotone feature is refused if its children's values are in the wrong order;
    below an accepted one their midpoint bounds the values on either side, so that the order
    holds for the whole subtree.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    prior = np.clip(np.mean(y), 1e-3, 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    z = np.full(len(y), bias)
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(value)
        for store, item in ((feature, 0), (limit, 0.0), (left, at), (right, at), (value, v)):
            store.append(item)
        return at

    def best_split(rows, g, h, low, high):
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, e in enumerate(edges):
            if len(e) == 0:
                continue
            code = binned[rows, j]
            gl = np.cumsum(np.bincount(code, g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(code, minlength=len(e) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
            allowed = (nl >= leaf_rows) & (len(rows) - nl >= leaf_rows)
            allowed &= monotone[j] * (vr - vl) >= 0
            gain = np.where(allowed, gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, vl[k], vr[k]))
        return best[1]

    def build(rows, g, h, low, high, level) -> int:
        at = leaf(rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)))
        split = best_split(rows, g, h, low, high) if level < depth and len(rows) >= 2 * leaf_rows else None
        if split is None:
            z[rows] += value[at]
            return at
        j, k, vl, vr = split
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        under = binned[rows, j] <= k
        feature[at], limit[at] = j, float(edges[j][k])
        left[at] = build(rows[under], g, h, *bounds[monotone[j]][0], level + 1)
        right[at] = build(rows[~under], g, h, *bounds[monotone[j]][1], level + 1)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0))
    return Forest(bias, *map(np.array, (roots, feature, limit, left, right, value)), depth)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "code", "label")), *(pa.array(found[f], pa.float64()) for f in FEATURES)],
            ["doc_id", "code", "label", *FEATURES],
        )


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Fit on up to ``sample_rows`` labelled documents, one text for each id; None without labels of both kinds."""
    sample = labelled_sample(labels, "quality", sample_rows)
    schema = "doc_id long, code long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("code")).join(F.broadcast(sample), "doc_id")
    rows = one_text_each(texts.mapInArrow(_measured, schema)).collect()
    rows.sort()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(np.unique(y)) < 2:
        return None
    return grow(np.array([[r[f] for f in FEATURES] for r in rows]), y, list(FEATURES.values()))


def judge(documents: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, and the trees' score."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column("text"))
            words = found["n_words"]
            failed = (words < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            score = np.ones(len(words))
            if forest is not None and len(words):
                score = forest.score(np.stack([found[f] for f in FEATURES], axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(found[c].astype(np.int64)) for c in COUNTS),
                    pa.array(failed.astype(bool)),
                    pa.array((~failed.astype(bool)) & (score >= threshold)),
                    pa.array(score, pa.float64()),
                ],
                ["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return documents.select("doc_id", "text").mapInArrow(judged, schema)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents, train(documents, labels))
