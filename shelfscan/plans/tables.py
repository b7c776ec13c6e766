"""The listing tables behind the queries, written once per session and read by all of them.

Loading and cleaning are done once and every analysis reads the stored result, as Parquet with
column pruning and filter pushdown. The tables live in the session's shared folder. They belong
to the names, sizes and times of the input files, so that changed input is loaded and cleaned anew.
So is a table whose files have gone meanwhile, by ``workspace.clean_up`` or with the shared folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfscan import schema
from shelfscan.operators import cleaning
from shelfscan.sources import files
from shelfscan.sources.driver_tables import input_paths, raw_listings
from shelfscan.sources.workspace import fresh_path

#: By application, name of the table, and files it is made from: its path, and what was written there.
_stored: dict[tuple, tuple[str, tuple[int, int]]] = {}
_lock = threading.RLock()


def _table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], layout) -> DataFrame:
    key = (spark.conf.get("spark.app.id"), name, files.fingerprint(spark, *input_paths(sf_dir)))
    with _lock:
        path, written = _stored.get(key, (None, None))
        if path is None or files.extent(spark, path) != written:
            path = fresh_path(spark, name)
            build().write.parquet(path)
            _stored[key] = path, files.extent(spark, path)
    return spark.read.schema(layout).parquet(path)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "raw", lambda: raw_listings(spark, sf_dir), schema.RAW)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "clean", lambda: cleaning.clean(raw(spark, sf_dir)), schema.CLEAN)


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings cleaned the dashboard's way."""
    return _table(
        spark, sf_dir, "dashboard", lambda: cleaning.clean_for_dashboard(raw(spark, sf_dir)), schema.CLEAN
    )


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings prepared for BI tools; a projection of the raw table, so not stored."""
    return cleaning.clean_light(raw(spark, sf_dir))
