"""Tables written to the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Each call writes to a fresh path, so a
rerun never meets half-written data, and a lost executor costs only the re-reading of a file.
All paths of a session lie in one folder of its own, which is removed when Python exits or
``clean_up`` is called; those made inside ``scratch`` are removed at its end, also on failure.

On a cluster a folder on files is tried out before it is used: tasks on all machines write to it, and
the driver has to find what they wrote.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: On a cluster, a path on files (or without a scheme) is taken as shared if this is set to true, as a
#: disk of each machine if it is false, and is tried out if it is not set.
SHARED_FILES = "spark.shelfscan.sharedFiles"

_lock = threading.RLock()
_folders: dict[str, list[str]] = {}  # by application: the session's own folder, then those of open scratches
_tried: dict[str, tuple[str, set[str]]] = {}  # by application: a folder found to be shared, and by which machines


def _one_machine(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "").startswith("local")


def _executors(spark: SparkSession) -> list[str]:
    """The machines of the executors that the session has by now, and that of the driver; one may come twice."""
    return [x.rpartition(":")[0] for x in spark._jsc.sc().getExecutorMemoryStatus().keys().mkString(" ").split()]


def seen_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether what all executors write to ``folder`` is found by the driver and read by executors.

    Each idle executor gets a task. What one wrote to a disk of its own machine is missing when the
    driver gathers the parts. The folder is tried again once the session has executors on other machines.
    """
    app, executors = spark.conf.get("spark.app.id"), _executors(spark)
    tried, machines = _tried.get(app, ("", set()))
    if tried == folder and machines.issuperset(executors):
        return True
    root = f"{folder.rstrip('/')}/shelfscan-{uuid.uuid4().hex}"
    tasks = 2 * len(executors)
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(f"{root}/tried")
        seen = spark.read.schema("id long").parquet(f"{root}/tried").count() == tasks
    finally:
        with contextlib.suppress(Exception):  # an error of the block itself is the one to be raised
            _remove(spark, root)
    if seen:
        _tried[app] = folder, set(executors)
    return seen


def shared_folder(spark: SparkSession, is_shared: Callable[[str], bool] = lambda folder: False) -> str:
    """The folder for intermediate tables; refused if executors could not all reach it.

    On a cluster a folder on files that no setting speaks of is refused unless ``is_shared`` finds it
    shared. Only a session whose executors are threads of this process gets a temporary folder when
    none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        on_files = "://" not in folder and not folder.startswith("hdfs:") or folder.startswith("file:")
        said = spark.conf.get(SHARED_FILES, "")
        if on_files and not _one_machine(spark) and said != "true":
            refusal = f"{folder} may be a disk of each machine; set {SHARED_FILES}=true if all of them share it"
            try:
                shared = not said and is_shared(folder)
            except Exception as problem:
                raise ValueError(refusal) from problem
            if not shared:
                raise ValueError(refusal)
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{tempfile.gettempdir()}/shelfscan"


def _own_folders(spark: SparkSession) -> list[str]:
    app = spark.conf.get("spark.app.id")
    with _lock:
        if app not in _folders or app in _tried:
            shared = shared_folder(spark, lambda folder: seen_by_all(spark, folder))
        if app not in _folders:
            _folders[app] = [f"{shared}/shelfscan-{uuid.uuid4().hex}"]
            atexit.register(_clean_up_quietly, spark)
        return _folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folders(spark)[-1]}/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Paths made inside are removed at the end; nothing lazy that reads them may outlive it."""
    folders = _own_folders(spark)
    folder = f"{folders[0]}/scratch-{uuid.uuid4().hex}"
    with _lock:
        folders.append(folder)
    try:
        yield
    finally:
        with _lock:
            folders.remove(folder)
        _remove(spark, folder)


def clean_up(spark: SparkSession) -> None:
    """Remove everything this session stored for itself."""
    with _lock:
        folders = _folders.pop(spark.conf.get("spark.app.id"), [])
    for folder in folders:
        _remove(spark, folder)


def _clean_up_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        clean_up(spark)
