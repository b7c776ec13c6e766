"""Sets of tables that change as one: readers see an old version or a new one, whole.

A version is a folder of its own with any number of tables. It is written first; then a small
manifest, which names its tables with their folders, formats and schemas, is put in place by one
rename. The manifest with the highest number is the current one, so nothing that a reader may
have open is touched, and a failed or killed write leaves what was there:

    root/_versions/<id>/<table>...     data
    root/_manifests/00000007.json      what version 7 consists of

Two writers at once can't both make version 8: the second finds it taken and becomes version 9,
or is refused if it said which version it meant to follow. ``vacuum`` removes versions that are
no longer kept, and what failed writes left behind.

The rename has to be one step, as on HDFS and local disks. Because manifests record schemas, what
a format forgets (decimals in JSON, text that looks like a number in folder names) comes back.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfscan.sources import files, sinks

MANIFESTS, VERSIONS = "_manifests", "_versions"
KEEP = 2
ABANDONED_AFTER_HOURS = 48.0


class VersionConflict(RuntimeError):
    """Another writer has made the version that this one was to follow or to be."""


class NoVersion(LookupError):
    """Nothing has been published there, or not that version or table."""


@dataclass(frozen=True)
class Table:
    """A table of a version: its folder (below the root), format, schema as JSON, and partition column."""

    folder: str
    fmt: str
    schema: str
    partition: str | None = None


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    tables: dict[str, Table]
    written: float  # seconds since 1970


#: A function that writes a table into the folder it is given.
Writer = Callable[[str], Table]


def table(build: Callable[[], DataFrame], fmt: str = "parquet", partition: str | None = None) -> Writer:
    """Write what ``build`` returns, in folders by ``partition`` if it is given."""

    def write(folder: str) -> Table:
        df = build()
        if partition:
            sinks.write_partitioned(df, folder, partition, fmt)
        else:
            sinks.write_table(df, folder, fmt)
        return Table(folder, fmt, df.schema.json(), partition)

    return write


def _manifest(root: str, number: int) -> str:
    return f"{root}/{MANIFESTS}/{number:08d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions there are, oldest first."""
    found = files.names(spark, f"{root}/{MANIFESTS}")
    return sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, by default the current one."""
    there = numbers(spark, root)
    if not there or (number is not None and number not in there):
        raise NoVersion(f"no version {'' if number is None else number} in {root}")
    found = json.loads(files.read_text(spark, _manifest(root, there[-1] if number is None else number)))
    return Version(**{**found, "tables": {name: Table(**entry) for name, entry in found["tables"].items()}})


def publish(
    spark: SparkSession,
    root: str,
    write: Callable[[str], dict[str, Table]],
    follows: int | None = None,
) -> Version:
    """Make a new version of what ``write`` puts into the folder that it is given, and returns the tables of.

    With ``follows`` (0: nothing yet), it is an error if the current version is another one. Until
    this returns, readers see the version before; if ``write`` fails they go on seeing it.
    """
    root = root.rstrip("/")
    folder = f"{root}/{VERSIONS}/{uuid.uuid4().hex}"
    with files.removed_on_failure(spark, folder):
        tables = write(folder)
        inside = {name: Table(t.folder.removeprefix(f"{root}/"), t.fmt, t.schema, t.partition) for name, t in tables.items()}
        while True:
            there = numbers(spark, root)
            current = there[-1] if there else 0
            if follows is not None and current != follows:
                raise VersionConflict(f"{root} is at version {current}, not {follows}")
            new = Version(current + 1, folder.removeprefix(f"{root}/"), inside, time.time())
            if _commit(spark, root, new):
                return new


def _commit(spark: SparkSession, root: str, new: Version) -> bool:
    """Put a manifest in place; False if there is one of that number."""
    files.make_folder(spark, f"{root}/{MANIFESTS}")
    aside = f"{root}/{MANIFESTS}/_{uuid.uuid4().hex}"
    files.write_text(spark, aside, json.dumps(asdict(new)))
    try:
        files.move(spark, aside, _manifest(root, new.number))
        return True
    except Exception:
        if not files.exists(spark, _manifest(root, new.number)):
            raise
        return False
    finally:
        files.remove(spark, aside)


def publish_tables(spark: SparkSession, root: str, writers: dict[str, Writer], follows: int | None = None, at_once: int = 4) -> Version:
    """A version of these tables, small ones written side by side. If one fails, there is no version."""
    return publish(
        spark, root, lambda folder: sinks.run_all({n: (lambda n=n, w=w: w(f"{folder}/{n}")) for n, w in writers.items()}, at_once), follows
    )


def replace(df: DataFrame, root: str, fmt: str = "parquet", follows: int | None = None) -> Version:
    """Make ``df`` the table at ``root``; it may be computed from the version there is."""
    return publish_tables(df.sparkSession, root, {"table": table(lambda: df, fmt)}, follows)


def folder_of(root: str, found: Version, name: str) -> str:
    if name not in found.tables:
        raise NoVersion(f"no table {name} in version {found.number} of {root}")
    return f"{root.rstrip('/')}/{found.tables[name].folder}"


def read(spark: SparkSession, root: str, name: str = "table", number: int | None = None, of: Version | None = None) -> DataFrame:
    """A table of the current version, of version ``number``, or of a version got before."""
    found = of or version(spark, root, number)
    path = folder_of(root, found, name)
    entry = found.tables[name]
    schema = T.StructType.fromJson(json.loads(entry.schema))
    if entry.partition:
        return sinks.read_partitioned(spark, path, schema, entry.partition, entry.fmt)
    return spark.read.schema(schema).format(entry.fmt).load(path)


def read_all(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version: they belong together, whatever is published meanwhile."""
    found = version(spark, root, number)
    return {name: read(spark, root, name, of=found) for name in found.tables}


def vacuum(spark: SparkSession, root: str, keep: int = KEEP, abandoned_after_hours: float = ABANDONED_AFTER_HOURS) -> list[int]:
    """Remove all but the newest ``keep`` versions, and folders that no manifest names and nobody can still be writing.

    Returns the versions removed. Someone who still reads a version that goes is cut off.
    """
    root = root.rstrip("/")
    there = numbers(spark, root)
    gone, kept = there[: max(0, len(there) - max(1, keep))], there[max(0, len(there) - max(1, keep)) :]
    folders = {version(spark, root, n).folder.rsplit("/", 1)[-1]: n for n in there}
    for name, changed in files.names(spark, f"{root}/{VERSIONS}").items():
        old = time.time() - changed / 1000 > abandoned_after_hours * 3600
        if folders.get(name) in gone or (name not in folders and old):
            files.remove(spark, f"{root}/{VERSIONS}/{name}")
    for number in gone:  # last, so that what a manifest names is there or known to be gone
        files.remove(spark, _manifest(root, number))
    assert kept or not there
    return gone
