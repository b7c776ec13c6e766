"""Tables that a session stored once and whose files went away before the next query."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

import pytest

from shelfscan.plans import tables
from shelfscan.plans.catalog import CATALOG
from shelfscan.sources import files, workspace


@pytest.fixture
def folder(tmp_path):
    """Inputs that no other test has loaded."""
    for name in tables.input_paths(str(tmp_path)):
        shutil.copy(f"/root/testdata/sf0.001/{Path(name).name}", name)
    return str(tmp_path)


def _stored(spark, folder, name):
    return Path(getattr(tables, name)(spark, folder).inputFiles()[0].removeprefix("file://")).parent


def _rows(spark, folder, name):
    return sorted(map(tuple, CATALOG[name](spark, folder).collect()), key=repr)


def test_after_clean_up(spark, folder, monkeypatch):
    """The session goes on after it removed what it had stored."""
    monkeypatch.setattr(workspace, "_folders", {})
    names = ["b02_discount_by_category", "b14_pareto", "b21_sketched_products", "d01_kpis"]
    before = {name: _rows(spark, folder, name) for name in names}
    workspace.clean_up(spark)
    assert {name: _rows(spark, folder, name) for name in names} == before


@pytest.mark.parametrize("table", ["raw", "clean"])
def test_without_its_folder(spark, folder, table):
    before = {name: _rows(spark, folder, name) for name in ("b05_stockout_ranking", "c01_row_count")}
    shutil.rmtree(_stored(spark, folder, table))
    assert {name: _rows(spark, folder, name) for name in before} == before


def test_without_some_of_its_files(spark, folder):
    """What is left of a table is not taken for the whole of it."""
    before = _rows(spark, folder, "b10_quantity_by_category")
    for part in _stored(spark, folder, "clean").glob("*.parquet"):
        os.remove(part)
    assert _rows(spark, folder, "b10_quantity_by_category") == before


def test_extent(spark, tmp_path):
    assert files.extent(spark, f"{tmp_path}/none") == (0, 0)
    (tmp_path / "a").write_bytes(b"123")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c").write_bytes(b"45")
    assert files.extent(spark, f"file://{tmp_path}") == (2, 5)
