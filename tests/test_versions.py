"""Tables that are replaced while they are read, and replacements that fail."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfscan.operators import cleaning, marts
from shelfscan.plans import job, tables
from shelfscan.sources import files, listings, sinks, versions


class Broken(Exception):
    pass


def _broken(folder):
    raise Broken


def ids(df) -> list:
    return sorted(r["id"] for r in df.collect())


def test_versions_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(versions.NoVersion):
        versions.read(spark, root)
    assert versions.replace(spark.range(3), root).number == 1
    open_already = versions.read(spark, root)
    assert versions.replace(versions.read(spark, root).where("id > 0"), root).number == 2
    assert ids(versions.read(spark, root)) == [1, 2]
    assert ids(open_already) == ids(versions.read(spark, root, number=1)) == [0, 1, 2]
    assert versions.numbers(spark, root) == [1, 2]


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(spark.range(3), root)

    def half(folder):
        spark.range(9).write.parquet(f"{folder}/table")
        raise Broken

    with pytest.raises(Broken):
        versions.publish(spark, root, half)
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.replace(bad, root)
    assert ids(versions.read(spark, root)) == [0, 1, 2] and versions.numbers(spark, root) == [1]
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 1  # what failed is removed


KILLED = """
import sys, time
sys.path.insert(0, sys.argv[2])
from pyspark.sql import SparkSession
from shelfscan.sources import versions
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()

def half(folder):
    spark.range(1000).write.parquet(f"{folder}/table")
    print("WRITTEN", flush=True)
    time.sleep(300)

versions.publish(spark, sys.argv[1], half)
"""


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    """The process ends, without any clean-up, when its data is written and its manifest is not."""
    root = str(tmp_path / "t")
    versions.replace(spark.range(3), root)
    command = [sys.executable, "-c", KILLED, root, str(Path(__file__).resolve().parents[1])]
    writer = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
    try:
        assert any(line.strip() == "WRITTEN" for line in writer.stdout)
    finally:
        os.killpg(writer.pid, signal.SIGKILL)
        writer.wait()
    assert ids(versions.read(spark, root)) == [0, 1, 2]
    assert versions.replace(spark.range(1), root).number == 2
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 3
    versions.vacuum(spark, root, keep=2)  # the killed one may be at work still, for all one knows
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 3
    versions.vacuum(spark, root, keep=2, abandoned_after_hours=0)
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 2
    assert ids(versions.read(spark, root)) == [0]


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(spark.range(1), root)

    def meanwhile(folder):
        versions.replace(spark.range(2), root)
        return {"table": versions.table(lambda: spark.range(3))(f"{folder}/table")}

    with pytest.raises(versions.VersionConflict):
        versions.publish(spark, root, meanwhile, follows=1)
    assert ids(versions.read(spark, root)) == [0, 1]
    assert versions.publish(spark, root, meanwhile).number == 4  # after the third, which was made meanwhile
    assert ids(versions.read(spark, root)) == [0, 1, 2]
    # a number that is taken is not written over
    taken = versions.version(spark, root, 2)
    assert versions._commit(spark, root, taken) is False
    assert not [p for p in (tmp_path / "t" / "_manifests").iterdir() if p.name.startswith("_")]


def test_vacuum_keeps_the_newest(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(1, 5):
        versions.replace(spark.range(n), root)
    assert versions.vacuum(spark, root, keep=2) == [1, 2]
    assert versions.numbers(spark, root) == [3, 4]
    assert ids(versions.read(spark, root, number=3)) == [0, 1, 2]
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 2
    assert versions.vacuum(spark, root, keep=0) == [3]  # never the current one
    assert versions.vacuum(spark, str(tmp_path / "nothing")) == []


def test_marts_change_together(spark, raw, tmp_path):
    root = str(tmp_path / "marts")
    df = cleaning.clean_for_dashboard(raw({"category": "a"}, {"category": "b"}))
    marts.publish_marts(df, root, "json")
    before = {name: t.collect() for name, t in versions.read_all(spark, root).items()}
    assert before["kpis"][0]["total_skus"] == 2

    more = cleaning.clean_for_dashboard(raw(*[{"category": c} for c in "abc"]))
    writers = {**marts.mart_writers(more, "json"), "oos_by_category": _broken}
    with pytest.raises(Broken):
        versions.publish_tables(spark, root, writers)
    after = versions.read_all(spark, root)
    assert {name: t.collect() for name, t in after.items()} == before
    # types that JSON does not keep are those of the tables
    assert after["all_rows"].dtypes == df.dtypes
    marts.publish_marts(more, root, "json")
    assert versions.read(spark, root, "kpis").first()["total_skus"] == 3


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_values_that_folder_names_lose(spark, tmp_path, fmt):
    values = ["", None, "007", "7", "∅", "∅∅x", "a/b=c %", "é", "__HIVE_DEFAULT_PARTITION__x", " x "]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "category string, n int")
    path = sinks.write_partitioned(df, str(tmp_path / "p"), "category", fmt)
    back = sinks.read_partitioned(spark, path, df.schema, "category", fmt)
    assert back.dtypes == df.dtypes
    assert [r["category"] for r in back.orderBy("n").collect()] == values
    for i, v in enumerate(values):
        one = sinks.one_value(back, "category", v)
        assert [r["n"] for r in one.collect()] == [i]
    plan = sinks.one_value(back, "category", "007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan  # other folders are not read


def test_a_failed_overwrite_leaves_the_table(spark, tmp_path):
    path = sinks.write_table(spark.range(3), str(tmp_path / "t"))
    bad = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write_table(bad, path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2]
    sinks.write_table(spark.read.parquet(path).where("id > 0"), path)  # computed from itself
    assert ids(spark.read.parquet(path)) == [1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_an_overwrite_cut_off_between_its_renames(spark, tmp_path):
    path = sinks.write_table(spark.range(3), str(tmp_path / "t"))
    folder, place = sinks._beside(path, "old")
    files.make_folder(spark, folder)
    files.move(spark, path, place)  # and then nothing more
    sinks.put_back(spark, path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2]


def test_the_job_as_one_version(spark, raw, tmp_path):
    root = str(tmp_path / "out")
    good = listings.write_csv(raw({}, {"category": "B"}), str(tmp_path / "good"))
    first = job.publish(spark, good, root)
    assert {"raw", "clean", "dashboard_all_rows", "dashboard_scatter", "b17_lost_revenue"} <= first.tables.keys()
    bad = listings.write_csv(raw({"sku_id": "a"}, {"sku_id": "a"}), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="sku_id"):
        job.publish(spark, bad, root)
    assert versions.read(spark, root, "raw").count() == 2
    assert versions.numbers(spark, root) == [1]


def test_changed_input_is_loaded_anew(spark, tmp_path):
    folder = tmp_path / "sf"
    folder.mkdir()
    for name in ("lineitem", "part"):
        (folder / f"{name}.parquet").write_bytes(Path(f"/root/testdata/sf0.001/{name}.parquet").read_bytes())
    before = tables.clean(spark, str(folder)).count()
    assert tables.clean(spark, str(folder)).inputFiles() == tables.clean(spark, str(folder)).inputFiles()
    time.sleep(0.01)
    lines = pq.read_table("/root/testdata/sf0.001/lineitem.parquet")
    pq.write_table(lines.slice(0, lines.num_rows // 2), folder / "lineitem.parquet")
    assert 0 < tables.clean(spark, str(folder)).count() < before
