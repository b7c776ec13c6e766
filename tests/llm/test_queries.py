"""The registered queries, against their SQL where there is any."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_points
from shelfscan.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA


def test_one_query_for_each_operator():
    numbers = [int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES
    assert entry_points.queries().items() >= QUERIES.items()
    assert entry_points.oracle_sql().items() >= ORACLES.items()


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = [tuple(r[order.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


CONTRACT = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3": "doc_id n_shingles component_id kept",
    "op4": "page_id url text n_chars",
    "op5": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8": "page_id payload_bytes payload_digest record_type refers_to",
    "op9": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id size source_size target taken",
    "op12": "doc_id n_features weight score rank",
    "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("number", list(CONTRACT))
def test_columns(spark, number):
    (name,) = [n for n in QUERIES if n.startswith(f"{number}_")]
    assert QUERIES[name](spark, DATA).columns[: len(CONTRACT[number].split())] == CONTRACT[number].split()
