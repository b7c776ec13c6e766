"""A folder on plain files under a cluster's master: used if all executors share it, refused if not."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry_points
from shelfscan.plans import tables
from shelfscan.sources import workspace
from tests.conftest import DATA
from tests.test_sources import _Session


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as if its master were a cluster's, before it has stored anything."""
    monkeypatch.setattr(workspace, "_folders", {})
    monkeypatch.setattr(workspace, "_tried", {}, raising=False)
    monkeypatch.setattr(tables, "_stored", {})
    monkeypatch.setattr(workspace, "_one_machine", lambda spark: False)
    yield spark
    workspace.clean_up(spark)


@pytest.fixture
def folder(spark):
    return spark.conf.get("spark.checkpoint.dir")


STORING = [
    "b02_discount_by_category",
    "b14_pareto",
    "b21_sketched_products",
    "c01_c15_observed_audit",
    "op4_site_templates",
    "op5_packing",
    "op8_warc",
    "op11_fair_mix",
]


@pytest.mark.parametrize("name", STORING)
def test_queries_that_store_tables(cluster, folder, name):
    before = set(os.listdir(folder))
    assert entry_points.queries()[name](cluster, DATA).count() > 0
    own = workspace._folders[cluster.conf.get("spark.app.id")][0]
    assert set(os.listdir(folder)) - before == {Path(own).name}  # nothing is left of the trial


def test_pipeline_stage_that_stores(cluster):
    from corpus_pipeline import drop_near_duplicates

    documents = cluster.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    kept = drop_near_duplicates(cluster, documents, DATA)
    assert sorted(r["text"] for r in kept.collect()) == ["a b c d e f", "g h i j k l"]


def test_a_folder_that_is_no_folder(cluster):
    with pytest.raises(Exception):  # noqa: B017  Spark's own, whichever it is
        workspace.seen_by_all(cluster, "/proc/none")
    session = _Session(spark_master="yarn", spark_checkpoint_dir="/proc/none")
    with pytest.raises(ValueError, match="sharedFiles") as refused:
        workspace.shared_folder(session, lambda folder: workspace.seen_by_all(cluster, folder))
    assert refused.value.__cause__ is not None


def test_a_machine_that_has_its_own_disk(cluster, folder, monkeypatch):
    """What one of the tasks wrote is not where the driver looks for it."""
    write = DataFrameWriter.parquet

    def lose_one(self, path):
        write(self, path)
        os.remove(min(Path(path).glob("*.parquet")))

    monkeypatch.setattr(DataFrameWriter, "parquet", lose_one)
    before = os.listdir(folder)
    assert not workspace.seen_by_all(cluster, folder)
    with pytest.raises(ValueError, match="sharedFiles"):
        workspace.fresh_path(cluster, "x")
    assert os.listdir(folder) == before


def test_tried_once_for_all_machines(cluster, monkeypatch):
    machines, tried = ["a", "b"], []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(workspace, "_executors", lambda spark: list(machines))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (tried.append(path), write(self, path)))
    paths = [workspace.fresh_path(cluster, "x") for _ in range(3)]
    assert len(tried) == 1
    machines.append("b")
    paths.append(workspace.fresh_path(cluster, "x"))
    assert len(tried) == 1
    machines.append("c")
    paths.append(workspace.fresh_path(cluster, "x"))
    assert len(tried) == 2
    assert len({Path(p).parents[1] for p in paths}) == 1


@pytest.mark.parametrize(("said", "used"), [("true", True), ("false", False)])
def test_the_setting_goes_before_the_trial(said, used):
    session = _Session(spark_master="yarn", spark_checkpoint_dir="/tmp/x", spark_shelfscan_sharedFiles=said)

    def never(folder):
        raise AssertionError

    if used:
        assert workspace.shared_folder(session, never) == "/tmp/x"
    else:
        with pytest.raises(ValueError, match="sharedFiles"):
            workspace.shared_folder(session, never)
