from __future__ import annotations

from pathlib import Path

import pytest

from shelfscan import schema
from shelfscan.sources import listings, workspace

HEADER = ",".join(schema.RAW.fieldNames())
GOOD = 'S1,"Fruits, fresh","The ""big"" Café",1000,10,900,250,5,False'


def _file(tmp_path, *lines, encoding="utf-8"):
    path = tmp_path / "in.csv"
    path.write_bytes("\n".join([HEADER, *lines, ""]).encode(encoding))
    return str(path)


def test_quotes_blank_lines_and_empty_fields(spark, tmp_path):
    path = _file(tmp_path, GOOD, "", 'S2,,"",,,,,,')
    rows = listings.read_strict(spark, path).orderBy("sku_id").collect()
    assert tuple(rows[0]) == ("S1", "Fruits, fresh", 'The "big" Café', 1000, 10, 900, 250, 5, "False")
    assert tuple(rows[1]) == ("S2", None, "", None, None, None, None, None, None)


@pytest.mark.parametrize("line", ["S2,short", "S2,c,n,abc,1,1,1,1,True", "S2,c,n,1,1,1,1,1,True,extra"])
def test_strict_load_fails_on_a_bad_line(spark, tmp_path, line):
    path = _file(tmp_path, GOOD, line)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        listings.save_table(listings.read_strict(spark, path), str(tmp_path / "table"))


def test_quarantine(spark, tmp_path):
    bad = ["S2,short", "S3,c,n,abc,1,1,1,1,True"]
    good, rejected = listings.read_with_quarantine(spark, _file(tmp_path, GOOD, *bad))
    assert good.count() == 1
    assert sorted(r["line"] for r in rejected.collect()) == bad


def test_lenient_load(spark, tmp_path):
    path = _file(
        tmp_path,
        GOOD,
        "S2,short",
        'S3,,"a, b",12abc,x,,7.9,,True,extra,"and, more"',
        "S4,c,n,1,2,3,4,5,",
        '"S5, quoted","only, three",n',
    )
    rows = {r["sku_id"]: tuple(r)[1:] for r in listings.read_lenient(spark, path).collect()}
    assert rows.keys() == {"S1", "S3", "S4"}
    assert rows["S3"] == ("", "a, b", 12, None, None, 7, 0, "True")
    assert rows["S4"] == ("c", "n", 1, 2, 3, 4, 5, "")


def test_code_page(spark, tmp_path):
    path = _file(tmp_path, "S1,Café,It’s – 5 € Šó,1,2,3,4,5,True", encoding="cp1252")
    row = listings.read_strict(spark, path, "WIN1252").first()
    assert (row["category"], row["name"]) == ("Café", "It’s – 5 € Šó")


def test_written_files_read_back(spark, raw, tmp_path):
    df = raw({"name": 'a,"b"\'é & (c)'}, {"name": "", "mrp": None}, {"name": None, "out_of_stock": None})
    for encoding in ("UTF-8", "windows-1252"):
        path = listings.write_csv(df, str(tmp_path / encoding), encoding)
        again = listings.read_strict(spark, path, encoding)
        assert again.orderBy("sku_id").collect() == df.orderBy("sku_id").collect()


def test_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert workspace.fresh_path(spark, "x").startswith(folder)
    assert workspace.fresh_path(spark, "x") != workspace.fresh_path(spark, "x")


class _Conf:
    def __init__(self, **values):
        self.values = {key.replace("_", "."): value for key, value in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**values)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workspace.shared_folder(_Session(spark_master=master, spark_app_id="a"))
    local = _Session(spark_master="local[2]", spark_app_id="unset")
    assert workspace.shared_folder(local) == workspace.shared_folder(local)


@pytest.mark.parametrize("folder", ["file:/tmp/x", "file:///tmp/x", "/tmp/x"])
def test_a_cluster_does_not_share_plain_paths(folder):
    cluster = _Session(spark_master="yarn", spark_checkpoint_dir=folder)
    with pytest.raises(ValueError, match="sharedFiles"):
        workspace.shared_folder(cluster)
    cluster.conf.values[workspace.SHARED_FILES] = "true"
    assert workspace.shared_folder(cluster) == folder
    for good in ("hdfs://name/x", "hdfs:/x", "s3a://bucket/x"):
        assert workspace.shared_folder(_Session(spark_master="yarn", spark_checkpoint_dir=good)) == good
    assert workspace.shared_folder(_Session(spark_master="local-cluster[2,1,9]", spark_checkpoint_dir=folder)) == folder


def test_scratch_folders_are_removed(spark):
    kept = workspace.materialize(spark.range(3), "kept")
    with pytest.raises(RuntimeError), workspace.scratch(spark):
        inside = workspace.fresh_path(spark, "x")
        spark.range(3).write.parquet(inside)
        raise RuntimeError
    assert not Path(inside).exists()
    assert kept.count() == 3


def test_a_header_must_fit(spark, tmp_path):
    names = schema.RAW.fieldNames()
    turned = [*names[:4], names[5], names[4], *names[6:]]
    renamed = ["sku", *names[1:]]
    for i, header in enumerate((turned, renamed)):
        path = tmp_path / f"{i}.csv"
        path.write_text(",".join(header) + "\n" + GOOD + "\n")
        with pytest.raises(Exception, match="header"):
            listings.save_table(listings.read_strict(spark, str(path)), str(tmp_path / "table"))
        with pytest.raises(Exception, match="header"):
            listings.read_with_quarantine(spark, str(path))
        assert listings.read_strict(spark, str(path), by_position=True).first()["discount_percent"] == 10
        good, _ = listings.read_with_quarantine(spark, str(path), by_position=True)
        assert good.count() == 1


def test_line_breaks_in_quotes_on_request(spark, tmp_path):
    path = _file(tmp_path, 'S1,c,"two\nlines",1,2,3,4,5,True')
    assert listings.read_strict(spark, path, line_breaks=True).first()["name"] == "two\nlines"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        listings.save_table(listings.read_strict(spark, path), str(tmp_path / "table"))
