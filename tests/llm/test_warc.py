from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from shelfscan.llm import warc
from tests.conftest import DATA

LAYOUT = "page_id long, url string, html string, digest string, shard long, refers_to string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "d", 3, "r") for i, u, h in rows], LAYOUT)


def brute(rows: list[tuple]) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, h in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        revisit = raw in first and first[raw] != i
        digest = hashlib.sha256(raw).hexdigest()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    assert found(warc.round_trip(df)) == brute([(r["page_id"], r["html"]) for r in df.collect()])


@pytest.fixture
def odd_pages(spark):
    long = "<p>" + "x" * 200
    return pages(
        spark,
        (5, "http://a/", long), (3, None, long), (9, "http://b/\r\nX: y", long), (3, None, long), (None, "u", long),
        (1, "u", None), (2, "u", ""), (4, "é", "é" * 49), (6, "u", "é" * 50), (7, "u", "é" * 50),
        (8, "u", "WARC/1.1\r\n\r\n" * 20), (None, "v", "only " * 50), (None, "w", "only " * 50), (3, "u", "other " * 30),
    )


def test_odd_rows(spark, odd_pages):
    assert found(warc.round_trip(odd_pages)) == brute([(r["page_id"], r["html"]) for r in odd_pages.collect()])
    assert warc.round_trip(pages(spark)).collect() == []


def written(spark, df, folder, **options) -> dict[str, str]:
    manifest = warc.write(df, str(folder), **options)
    names = {r["path"]: r["sha256"] for r in manifest.collect()}
    for name, digest in names.items():
        assert hashlib.sha256((Path(folder) / name).read_bytes()).hexdigest() == digest
    assert not list(Path(folder).glob("_temporary/*/*.gz"))
    return names


def test_same_files_whatever_the_partitions(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    options = {"shard_bytes": 20_000, "file_bytes": 3_000}
    a = written(spark, df, tmp_path / "a", **options)
    b = written(spark, df.repartition(13, "url"), tmp_path / "b", **options)
    assert a == b and len(a) > 10
    ids = []
    for name in sorted(a):
        with gzip.open(tmp_path / "a" / name) as stream:
            ids += [warc._id(r["fields"]["warc-record-id"]) for r in warc.parse(stream)]
    assert ids == sorted(ids)


def test_only_the_manifest_counts(spark, tmp_path, odd_pages):
    folder = str(tmp_path / "w")
    manifest = warc.write(odd_pages, folder)
    (tmp_path / "w" / "000099-00000.warc.gz").write_bytes(b"left by a lost task")
    assert len(warc.read(manifest, folder).collect()) == odd_pages.count()


def test_damage_is_noticed(spark, tmp_path, odd_pages):
    folder = tmp_path / "w"
    manifest = warc.write(odd_pages, str(folder))
    name = manifest.first()["path"]
    raw = gzip.decompress((folder / name).read_bytes()).replace(b"xxx", b"xyx")
    (folder / name).write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="damaged"):
        warc.read(manifest, str(folder)).collect()
