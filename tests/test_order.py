"""Reports that end in a sort return their rows in that order, as their SQL does."""

from __future__ import annotations

import pytest

from shelfscan.plans import oracle
from shelfscan.plans.catalog import CATALOG
from tests.conftest import DATA

WITHOUT_ORDER = """s01 s02 s03 s04 s05 s06 s07 c01 c05 c06 c07 c08 c09 c10 c11 c12 c13 c14 c15 c16 c17 c18 c19 c20 c21 c22
    c23 c24 c26 e01 e04 e08 b14_pareto_all b18 b21 f1 f2 f3 f4 f5 j1 j2 j3 j4 j5 d01 d05_d06 d10 d11 m1 m2 m3 m4 m5 m6 m7"""


def test_every_sorted_report_is_listed():
    plain = tuple(WITHOUT_ORDER.split())
    assert {n for n in CATALOG if not n.startswith(plain) or n == "b14_pareto"} >= oracle.ORDER.keys()
    assert {n for n in CATALOG if not n.startswith(plain)} - {"d05_discount_distribution"} <= oracle.ORDER.keys()


def ordered(duck, name: str, columns: list[str], sql: str) -> list[tuple]:
    order = oracle.ORDER[name]
    result = duck.execute(f"SELECT * FROM ({sql}) ORDER BY {order}" if order else sql)
    places = [[d[0] for d in result.description].index(c) for c in columns]
    return [tuple(row[i] for i in places) for row in result.fetchall()]


@pytest.mark.parametrize("name", list(oracle.ORDER))
def test_order(spark, duck, name):
    df = CATALOG[name](spark, DATA)
    columns = oracle.SORTED_BY.get(name, df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    assert got == ordered(duck, name, columns, oracle.ORACLE[name])
