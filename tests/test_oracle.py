"""Every named query gives what its SQL gives on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from shelfscan.plans.catalog import CATALOG as QUERIES
from shelfscan.plans.oracle import ORACLE
from tests.conftest import DATA

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert entry_points.queries().items() >= QUERIES.items()
    assert entry_points.oracle_sql().items() >= ORACLE.items()


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns[0] == "category"
    assert result.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]

    result = duck.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    want = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]

    assert sorted(types) == columns
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    assert _sorted(got) == _sorted(want)
