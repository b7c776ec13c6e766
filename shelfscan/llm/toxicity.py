"""Toxicity score by a factorization machine over hashed terms.

A text is the set of its terms, hashed to 32 bits: runs of letters and digits, A-Z in lower
case, and the first bytes of each run, which stand for its inflected forms. Besides a weight, each term has a short vector, and each pair of terms in a text adds the
product of their vectors; so an insult beside the mention of a group can weigh more than the
two alone. The pair sums are computed from sums over single terms, in time linear in the text.

The machine is fitted on a bounded sample of labelled documents and travels to the tasks as
arrays of at most ``max_terms`` rows; scoring is one pass without a shuffle.

Nulls: a null text is empty and has the score of a text without known terms; a null doc_id is
scored and counts as not held out. Rows that are repeated are scored each. Without labelled
rows every score is the prior, 0.25.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan.llm import arrays
from shelfscan.llm.sample import fold, labelled_sample, one_text_each

SAMPLE_ROWS = 10_000
MAX_TERMS = 16_384
MIN_DOCUMENTS = 3  # sampled documents that hold a term, at least
PREFIX = 4  # bytes of a word that are a term of their own
MAX_POSITIVE_WEIGHT = 8.0  # of a toxic document against another, where toxic ones are rare
MIN_CHI_SQUARE = 15.0  # terms below are noise that would be learnt by heart
FACTORS = 6
EPOCHS = 12
THRESHOLD = 0.5

_IN_TERM = arrays.byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))


@dataclass(frozen=True)
class Machine:
    """``terms`` sorted; ``weight`` one and ``vector`` FACTORS numbers for each."""

    bias: float
    terms: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def score(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts from their distinct (text, term) pairs."""
        z = np.full(n, self.bias)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            known = self.terms[at] == term
            at, text = at[known], text[known]
            z += np.bincount(text, weights=self.weight[at], minlength=n)
            for f in range(self.vector.shape[1]):
                v = self.vector[at, f]
                z += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_terms(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, number of texts and their distinct (text, term) pairs, by slices."""
    for first, data, bounds in arrays.text_slices(column):
        data = arrays.LOWER[data]
        starts, ends, text = arrays.spans(_IN_TERM[data], bounds)
        words = arrays.span_hash(data, starts, ends)
        long = ends - starts > PREFIX
        heads = arrays.span_hash(data, starts[long], starts[long] + PREFIX, seed=2)
        owner, term = np.r_[text, text[long]], (np.r_[words, heads] >> arrays.U64(32)).astype(np.uint32)
        yield first, len(bounds) - 1, *arrays.distinct(owner, term)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs: list[bytes] = []
        for _, n, text, term in text_terms(batch.column("text")):
            cuts = np.searchsorted(text, np.arange(n + 1))
            blobs += [term[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("code"), batch.column("label"), pa.array(blobs, pa.binary())],
            ["doc_id", "code", "label", "terms"],
        )


def _choose_terms(term: np.ndarray, y: np.ndarray, n: int, positive: int, most: int) -> np.ndarray:
    """The terms whose presence tells most about the label (chi-square), sorted."""
    names, code = np.unique(term, return_inverse=True)
    held = np.bincount(code, minlength=len(names)).astype(float)
    hits = np.bincount(code, weights=y, minlength=len(names))
    expected = held * positive / n
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - held / n), 1e-9)
    chi[held < MIN_DOCUMENTS] = 0
    best = np.lexsort((names, -chi))[:most]
    return np.sort(names[best[chi[best] >= MIN_CHI_SQUARE]])


def fit(blobs: list[bytes], labels: list[int], max_terms: int = MAX_TERMS, seed: int = 3) -> Machine:
    """Logistic loss, AdaGrad over batches of 64 texts, L2 on weights and vectors."""
    y = np.array(labels, dtype=float)
    n, positive = len(y), int(np.sum(y))
    prior = (positive + 0.5) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    rows = [np.frombuffer(b, np.uint32) for b in blobs]
    if not 0 < positive < n:
        return Machine(bias, np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)))
    sizes = np.array([len(r) for r in rows])
    term = np.concatenate(rows)
    terms = _choose_terms(term, np.repeat(y, sizes), n, positive, max_terms)
    if not len(terms):
        return Machine(bias, terms, np.zeros(0), np.zeros((0, FACTORS)))
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    known = terms[at] == term
    owner, at = np.repeat(np.arange(n), sizes)[known], at[known]
    cuts = np.searchsorted(owner, np.arange(n + 1))

    heavy = min(MAX_POSITIVE_WEIGHT, (n - positive) / positive)
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), random.normal(0, 0.02, (len(terms), FACTORS))
    gw, gv, gb = np.full(len(terms), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        shuffled = random.permutation(n)
        for lot in np.array_split(shuffled, max(1, n // 64)):
            index = np.concatenate([at[cuts[i] : cuts[i + 1]] for i in lot])
            text = np.repeat(np.arange(len(lot)), cuts[lot + 1] - cuts[lot])
            held = v[index]
            total = np.zeros((len(lot), FACTORS))
            np.add.at(total, text, held)
            squares = np.bincount(text, weights=(held * held).sum(1), minlength=len(lot))
            z = bias + np.bincount(text, weights=w[index], minlength=len(lot)) + 0.5 * ((total**2).sum(1) - squares)
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lot]) * np.where(y[lot] == 1, heavy, 1.0) / len(lot)
            used, code = np.unique(index, return_inverse=True)
            dw = np.bincount(code, weights=miss[text], minlength=len(used)) + 1e-5 * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, code, miss[text][:, None] * (total[text] - held))
            dv += 1e-4 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += miss.sum() ** 2
            w[used] -= 0.3 * dw / np.sqrt(gw[used])
            v[used] -= 0.03 * dv / np.sqrt(gv[used])
            bias -= 0.1 * miss.sum() / np.sqrt(gb)
    return Machine(float(bias), terms, w, v)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Machine:
    """Fit on up to ``sample_rows`` labelled documents, whole texts, none of them in fold 0; of an id's texts one counts."""
    sample = labelled_sample(labels, "toxic", sample_rows)
    found = (
        documents.select("doc_id", "text", F.xxhash64("text").alias("code"))
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(_examples, "doc_id long, code long, label int, terms binary")
    )
    examples = one_text_each(found).collect()
    examples.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
    return fit([bytes(r["terms"]) for r in examples], [r["label"] for r in examples], max_terms)


def score(documents: DataFrame, machine: Machine, name: str = "toxicity") -> DataFrame:
    """All columns of ``documents`` and the score, from 0 to 1, in a column ``name`` that they don't have."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [machine.score(text, term, n) for _, n, text, term in text_terms(batch.column("text"))]
            values = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    fields = [T.StructField(f.name, f.dataType) for f in documents.schema]
    return documents.mapInArrow(scored, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``; all columns as they were."""
    name = "toxicity"
    while name in [c.lower() for c in documents.columns]:
        name += "_"
    return score(documents, train(documents, labels), name).where(F.col(name) < threshold).drop(name)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )
