"""Files and folders through Hadoop's file systems, so that any path Spark can write works."""

from __future__ import annotations

import contextlib

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def make_folder(spark: SparkSession, path: str) -> None:
    _system(spark, path).mkdirs(_path(spark, path))


def names(spark: SparkSession, folder: str) -> dict[str, int]:
    """What lies in ``folder``: name -> time of its last change in milliseconds; nothing if there is no such folder."""
    if not exists(spark, folder):
        return {}
    found = _system(spark, folder).listStatus(_path(spark, folder))
    return {status.getPath().getName(): status.getModificationTime() for status in found}


def extent(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of files in ``path`` and their bytes; (0, 0) if there is nothing."""
    if not exists(spark, path):
        return 0, 0
    summary = _system(spark, path).getContentSummary(_path(spark, path))
    return summary.getFileCount(), summary.getLength()


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; it is an error if there is one."""
    stream = _system(spark, path).create(_path(spark, path), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder. It is an error if ``target`` exists, also if it was made a moment ago."""
    full = _system(spark, target).makeQualified(_path(spark, target))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context.rename(_system(spark, source).makeQualified(_path(spark, source)), full, spark._sc._gateway.new_array(kind, 0))


@contextlib.contextmanager
def removed_on_failure(spark: SparkSession, path: str):
    """Remove ``path`` if the block fails; the block's own error is the one that is raised."""
    try:
        yield
    except BaseException:
        with contextlib.suppress(Exception):
            remove(spark, path)
        raise


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Name, size and time of every file in ``paths``: another value once one of them was written anew.

    A path where there is nothing counts as that.
    """
    found = []
    for path in paths:
        if not exists(spark, path):
            found.append((path, -1, -1))
            continue
        entries = _system(spark, path).listFiles(_path(spark, path), True)
        while entries.hasNext():
            status = entries.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))
