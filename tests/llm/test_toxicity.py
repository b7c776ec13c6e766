from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa

from shelfscan.llm import quality, toxicity
from tests.conftest import DATA
from tests.llm.conftest import documents


def terms(texts):
    column = pa.array(texts, pa.string())
    found = list(toxicity.text_terms(column))
    blobs = []
    for _, n, text, term in found:
        blobs += [term[text == i].tobytes() for i in range(n)]
    return blobs


def test_pairs_outweigh_single_terms():
    random = np.random.default_rng(5)
    filler = [f"f{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(1200):
        insult, group = bool(i & 1), bool(i & 2)
        words = list(random.choice(filler, 12)) + ["insult"] * insult + ["group"] * group
        texts.append(" ".join(random.permutation(words)))
        labels.append(int(insult and group))
    machine = toxicity.fit(terms(texts), labels)
    alone, beside, both = ("f1 f2 insult", "f1 f2 group", "f1 f2 group insult")
    column = pa.array([alone, beside, both])
    (_, n, text, term), = toxicity.text_terms(column)
    a, b, c = machine.score(text, term, n)
    assert c > 0.5 > max(a, b)
    # more than the two single effects together, on the scale of the sum
    logit = lambda p: np.log(p / (1 - p))
    assert logit(c) - logit(a) - logit(b) + machine.bias > 0.5


def test_score_equals_the_sum_over_pairs():
    random = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, np.arange(9, dtype=np.uint32) * 5, random.normal(size=9), random.normal(size=(9, 4)))
    held = [0, 3, 4, 8]
    z = 0.3 + machine.weight[held].sum()
    z += sum(machine.vector[i] @ machine.vector[j] for i, j in itertools.combinations(held, 2))
    term = np.array([5 * i for i in held] + [7], np.uint32)  # 7 is not known
    assert np.isclose(machine.score(np.zeros(5, np.int64), term, 1)[0], 1 / (1 + np.exp(-z)))


def test_held_out_accuracy(spark):
    data = DATA.replace("0.001", "0.1")
    documents, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in found if r["toxic"]]
    clean = [r for r in found if not r["toxic"]]
    assert len(toxic) > 50
    assert np.mean([r["predicted"] for r in toxic]) > 0.9
    assert np.mean([r["predicted"] for r in clean]) < 0.02


def test_only_text_and_other_folds_count(spark, corpus):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = labels.selectExpr("doc_id", "quality", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - toxic ELSE toxic END AS toxic")
    other = corpus.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source", "n_chars")
    a = toxicity.toxicity(corpus, labels).orderBy("doc_id").collect()
    b = toxicity.toxicity(other.repartition(7), turned.repartition(3)).orderBy("doc_id").collect()
    assert a == b
    assert {r["doc_id"] for r in a if r["held_out"]} == set(held)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (6, 1, 0), (6, 1, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (2, 3, 4)}) == 1
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert toxicity.toxicity(nothing, labels).collect() == []
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(odd, none).collect()} == {0.25}
    assert toxicity.drop_toxic(odd, none).columns == odd.columns
    assert toxicity.drop_toxic(odd.withColumnRenamed("kept", "Toxicity"), none).count() == odd.count()


def test_one_text_of_an_id_is_learnt_from(spark, monkeypatch):
    """An id that holds much of the table, with many texts, gives one example."""
    learnt = []
    monkeypatch.setattr(toxicity, "fit", lambda blobs, labels, most: learnt.append(labels) or None)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], f"another text {k}") for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    toxicity.train(documents(spark, *rows), labels)
    toxicity.train(documents(spark, *rows[::-1]).repartition(5), labels)
    assert learnt[0] == learnt[1] == [i % 2 for i in ids]
    grown = []
    monkeypatch.setattr(quality, "grow", lambda features, y, monotone: grown.append(features.tolist()))
    quality.train(documents(spark, *rows), labels)
    quality.train(documents(spark, *rows[::-1]).repartition(5), labels)
    assert len(grown[0]) == len(ids) and grown[0] == grown[1]
