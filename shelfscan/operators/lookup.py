"""Joining listings to a per-category table whose size is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.sources.workspace import materialize

BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 128
ROWS_PER_SALT = 1_000_000
MAX_SALTS = 4096


def is_small(table: DataFrame, text_columns: list[str], limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table, at ``ROW_BYTES`` per row besides its texts, is within ``limit``."""
    text = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in text_columns), F.lit(0))
    size = table.agg(F.coalesce(F.sum(text + F.lit(ROW_BYTES)), F.lit(0)).alias("bytes")).first()["bytes"]
    return size <= limit


def attach(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    wanted: Column,
    row_key: str = "sku_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join ``table`` (one row per ``key``) to the ``wanted`` rows; the rest get NULLs.

    ``table`` is written once and measured. Within ``broadcast_bytes`` it is broadcast and no
    row of ``rows`` moves. Beyond it only the wanted rows are shuffled, spread over copies of
    each key by a hash of their own identity, so that a hot key is shared out and a retried task
    sends each row where it went before. There is one copy for each ``ROWS_PER_SALT`` wanted
    rows, so a key that held all of them would still be shared out evenly.

    Calling this runs jobs: the table is stored and measured before the result is built.
    """
    table = materialize(table, "lookup")
    if is_small(table, [key], broadcast_bytes):
        return rows.join(F.broadcast(table), key, "left")

    values = [c for c in table.columns if c != key]
    salts = min(MAX_SALTS, rows.where(wanted).count() // ROWS_PER_SALT + 1)
    salted_table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_rows = rows.where(wanted).withColumn("salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))
    joined = salted_rows.join(salted_table.hint("merge"), [key, "salt"], "left").drop("salt")
    others = rows.where(~F.coalesce(wanted, F.lit(False))).withColumns(
        {c: F.lit(None).cast(table.schema[c].dataType) for c in values}
    )
    return joined.unionByName(others)
