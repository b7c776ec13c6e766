"""A deterministic, sharded writer of WARC archives, and their reader.

Records are sorted by id within shards that are ranges of ids of about equal payload; a shard's
bounds follow from exact counts of the table. Each task writes its shards' records one after the
other, each a gzip member of its own, and starts a new file when the compressed size is reached.
A file is written under a temporary name of the attempt and then renamed, and only files named
in the manifest, a Parquet table that Spark commits, belong to the archive. So a task that is
tried again writes the same bytes under the same names, and what a lost one left is never read.

Headers and digests are made anew from the payload. Of records with equal payloads of at least
``MIN_SHARED_BYTES`` bytes, that with the smallest id is a response and the others are revisits
that name it and hold its headers only; their size and digest are those of the full payload.

Nulls: a null payload is empty; null ids are sorted last and written as ``none``; a null url is
left out. Rows with one id and equal payloads are both responses. An empty table has an empty
manifest.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.storage import partitions, store
from shelfscan.sources.workspace import fresh_path

MIN_SHARED_BYTES = 100
SHARD_BYTES = 16 << 20  # of payload
FILE_BYTES = 4 << 20  # compressed
DATE = "2000-01-01T00:00:00Z"
MOST_BINS = 1 << 17

_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_MANIFEST = "path string, shard long, file long, records long, bytes long, sha256 string"


def _name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _id(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def _headers(*lines: tuple[str, str]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload))))
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        lines += [
            ("WARC-Refers-To", _name(refers_to)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    lines += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + _headers(*lines) + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class _File:
    """An archive file under its temporary name until it is closed."""

    def __init__(self, folder: str, shard: int, number: int):
        self.system, root = _open_folder(folder)
        self.shard, self.number = shard, number
        self.path = f"{root}/{shard:06d}-{number:05d}.warc.gz"
        self.written_to = f"{root}/_temporary/{TaskContext.get().taskAttemptId()}/{shard:06d}-{number:05d}.warc.gz"
        self.system.create_dir(self.written_to.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.written_to, compression=None)
        self.digest, self.bytes, self.records = hashlib.sha256(), 0, 0

    def add(self, raw: bytes) -> None:
        member = _member(raw)
        self.stream.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def commit(self) -> tuple:
        self.stream.close()
        self.system.move(self.written_to, self.path)
        return self.path.rpartition("/")[2], self.shard, self.number, self.records, self.bytes, self.digest.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield from batch.slice(at, 128).to_pylist()


def _shards(facts: DataFrame, shard_bytes: int) -> tuple[int, int, list[int]]:
    """Least id, width of a bin of ids, and the shard of each bin; bins are counted exactly."""
    span = facts.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum("payload_bytes").alias("bytes")).first()
    if span["low"] is None:
        return 0, 1, [0]
    bins = min(MOST_BINS, max(64, 16 * (span["bytes"] // shard_bytes + 1)))
    width = (span["high"] - span["low"]) // bins + 1
    counted = (
        facts.where("page_id IS NOT NULL")
        .groupBy(F.expr(f"(page_id - {span['low']}L) div {width}L").alias("bin"))
        .agg(F.sum("payload_bytes").alias("bytes"))
        .collect()  # MOST_BINS rows at most
    )
    sizes = dict(counted)
    shard, filled, out = 0, 0, []
    for b in range(bins):
        out.append(shard)
        filled += sizes.get(b, 0)
        if filled >= shard_bytes:
            shard, filled = shard + 1, 0
    return span["low"], width, out


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write an archive of ``pages`` (page_id, url, html) and return its manifest."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    facts = store(pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "facts")
    low, width, shards = _shards(facts, shard_bytes)
    table = F.array(*[F.lit(s) for s in shards])
    shard = F.coalesce(F.get(table, F.expr(f"(page_id - {low}L) div {width}L").cast("int")), F.lit(shards[-1] + 1)).cast("long")

    firsts = (
        facts.where(F.col("payload_bytes") >= MIN_SHARED_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL")
    )
    marks = (
        facts.join(firsts, "digest")
        .where("page_id IS NULL OR page_id > refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )
    nothing = F.lit(None)
    rows = marks.select(
        shard.alias("shard"), "page_id", "digest", "refers_to", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload")
    ).unionByName(pages.select(shard.alias("shard"), "page_id", "digest", nothing.cast("long").alias("refers_to"), "url", "payload"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, mark, names = None, None, [f.split()[0] for f in _MANIFEST.split(", ")]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, file.commit(), strict=True))])

        for row in _rows(batches):
            if row["payload"] is None:  # stands before the pages that it is about
                mark = row
                continue
            same = mark is not None and (mark["page_id"], mark["digest"]) == (row["page_id"], row["digest"])
            if file is not None and (file.shard != row["shard"] or file.bytes >= file_bytes):
                yield done()
                file = _File(folder, row["shard"], file.number + 1 if file.shard == row["shard"] else 0)
            file = file or _File(folder, row["shard"], 0)
            file.add(record(row["page_id"], row["url"], row["payload"], row["digest"], mark["refers_to"] if same else None))
        if file is not None:
            yield done()

    sorted_rows = rows.repartition(partitions(spark), "shard").sortWithinPartitions(
        "shard", F.asc_nulls_last("page_id"), "digest", F.col("payload").isNotNull(), "url"
    )
    manifest = sorted_rows.mapInArrow(written, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[dict]:
    """The records of an uncompressed stream: named fields, HTTP fields and payload."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = _fields(stream)
        block = stream.read(int(fields["content-length"]))
        if fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError(f"damaged block of {fields['warc-record-id']}")
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(_field(x) for x in head.split(b"\r\n")[1:])
        yield {"fields": fields, "http": http, "payload": payload}


def _field(line: bytes) -> tuple[str, str]:
    name, _, value = line.decode().partition(":")
    return name.strip().lower(), value.strip()


def _fields(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, value = _field(line)
        found[name] = value
    return found


def _row(found: dict) -> dict:
    fields, kind = found["fields"], found["fields"]["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and digest != hashlib.sha256(found["payload"]).hexdigest():
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return {
        "page_id": _id(fields["warc-record-id"]),
        "payload_bytes": int(found["http"]["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _id(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record of the files in the manifest: ids, size, digest and kind; digests are verified."""
    names = [f.split()[0] for f in _RECORD.split(", ")]
    layout = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names])

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, root = _open_folder(folder)
                rows = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for found in parse(stream):
                        rows.append(_row(found))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, layout)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, layout)

    paths = manifest.select("path").repartition(partitions(manifest.sparkSession))
    return paths.mapInArrow(read_files, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read it back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
