from __future__ import annotations

import re

import pytest

import corpus_pipeline
from shelfscan.llm import toxicity
from shelfscan.llm.storage import store
from tests.conftest import DATA
from tests.llm.conftest import documents
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import ids_of
from tests.llm.test_repeats import brute as repeats_brute


@pytest.fixture(scope="module")
def stages(spark):
    """The input of the first stage and the output of each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], DATA), name))
    return out


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "personal_data", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:5])
    assert all(df.schema["doc_id"].dataType == stages[0].schema["doc_id"].dataType for df in stages)


def test_toxic_documents_go(spark, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    scores = toxicity.toxicity(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert after == {i: r for i, r in before.items() if i in {r["doc_id"] for r in scores.where("predicted = 0").collect()}}
    assert 0 < len(before) - len(after) < len(before) / 3


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    expected = near_brute([(i, r["text"]) for i, r in before.items()], 5, 80)
    assert after == {i: before[i] for i, _, _, kept in expected if kept}
    assert len(after) < len(before)


def test_repeats_are_cut(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert before.keys() == after.keys()
    expected = {r[0]: r for r in repeats_brute([(i, r["text"]) for i, r in before.items()])}
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == before[i]["text"]) == (expected[i][2] == 0)
        assert len(before[i]["text"].encode()) - len(r["text"].encode()) >= expected[i][2]
    assert any(r[2] for r in expected.values())


def test_personal_data_is_masked(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    mail = re.compile(r"[\w.+-]+@mail\d+\.example\.com")
    assert before.keys() == after.keys()
    assert any(mail.search(r["text"]) for r in before.values())
    assert not any(mail.search(r["text"]) for r in after.values())


def test_packing_holds_every_token(stages):
    docs = by_id(stages[4])
    held: dict[int, int] = {}
    for p in stages[5].collect():
        held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["length"]
    assert held == {i: len(ids_of(r["text"])) for i, r in docs.items()}


def test_run_equals_the_stages(spark, stages):
    result = corpus_pipeline.run(spark, DATA)
    assert result.columns == stages[5].columns
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["doc_tokens"])
    total = lambda df: sum(r["length"] for r in df.collect())
    assert total(result) == total(stages[5])
    assert {key(r)[0] for r in result.collect()} == {key(r)[0] for r in stages[5].collect()}


def test_every_stage_takes_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            assert i == 4 or out.columns == docs.columns, name
            assert out.count() <= docs.count() or i == 4, name
            if name in ("toxicity", "repeats", "personal_data"):
                assert out.count() == docs.count(), name


def test_extra_columns_survive(spark):
    docs = documents(spark, (1, "a clean text of some words"), (2, "another clean text of words"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
    assert sorted((r["doc_id"], r["lang"], r["score"], r["kept"], r["text_code"], r["chunk"]) for r in docs.collect()) == [
        (1, "en", 0.5, True, "x", 7), (2, "en", 0.5, True, "x", 7)
    ]
