"""Reading raw listings from delimited text.

Three readers share one layout (header row, ``"`` quotes doubled to escape). An empty field is
NULL; a quoted empty field is an empty string.

A header must name the columns of the table in their order, unless the caller asks to read by
position; the lenient reader always reads by position. A field with a line break inside its
quotes is read whole only with ``line_breaks``, because a file can't be split among tasks then.

* ``read_strict`` fails the job on a line that does not fit the table;
* ``read_with_quarantine`` sets such lines aside;
* ``read_lenient`` takes what it can: short lines are dropped, further fields ignored, and a
  number is whatever digits its field starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan import schema
from shelfscan.sources.sinks import write_table
from shelfscan.sources.workspace import materialize

CORRUPT = "_corrupt_record"


def _single_byte_overrides(encoding: str) -> tuple[str, str]:
    """Characters that ``encoding`` places where ISO-8859-1 has control codes, as two strings."""
    pairs = []
    for byte in range(0x80, 0xA0):
        try:
            pairs.append((chr(byte), bytes([byte]).decode(encoding)))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _is_code_page(encoding: str) -> bool:
    return encoding.lower() in ("windows-1252", "win1252", "cp1252")


def _read(
    spark: SparkSession,
    path: str,
    layout: T.StructType,
    encoding: str,
    mode: str,
    header: bool,
    by_position: bool = True,
    line_breaks: bool = False,
) -> DataFrame:
    """Parse the text. Windows code page 1252 is read as ISO-8859-1, which keeps every byte and
    the delimiters, and the characters that differ are then replaced. All fields are parsed
    even if few are used, so that a bad line is found whatever the query reads."""
    code_page = _is_code_page(encoding)
    options = {
        "header": header,
        "enforceSchema": by_position,
        "multiLine": line_breaks,
        "columnPruning": False,
        "quote": '"',
        "escape": '"',
        "nullValue": "\\N",
        "encoding": "ISO-8859-1" if code_page else encoding,
        "mode": mode,
        "columnNameOfCorruptRecord": CORRUPT,
    }
    df = spark.read.schema(layout).options(**options).csv(path)
    if code_page:
        text = [f.name for f in layout if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.translate(c, *_single_byte_overrides("cp1252")) for c in text})
    return df


def read_strict(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    header: bool = True,
    by_position: bool = False,
    line_breaks: bool = False,
) -> DataFrame:
    """Load for ``save_table``, which reads every field; Spark checks a field only when it is
    read, so a bare row count would not notice a bad number."""
    return _read(spark, path, schema.RAW, encoding, "FAILFAST", header, by_position, line_breaks)


def read_with_quarantine(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    header: bool = True,
    by_position: bool = False,
    line_breaks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The listings that fit the table, and the text of the lines that do not.

    The parsed lines are stored once and both results read that: the text is parsed once, and
    Spark does not answer a query for the rejected text alone from the file itself.
    """
    layout = T.StructType([*schema.RAW.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = _read(spark, path, layout, encoding, "PERMISSIVE", header, by_position, line_breaks)
    lines = materialize(parsed, "parsed")
    bad = F.col(CORRUPT).isNotNull()
    return lines.where(~bad).drop(CORRUPT), lines.where(bad).select(F.col(CORRUPT).alias("line"))


def _field_count(line: Column) -> Column:
    """Fields of a line: its commas outside quotes, plus one."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _leading_integer(field: Column) -> Column:
    """The whole number a field starts with, NULL if it does not start with one."""
    return F.regexp_extract(field, r"^\s*([+-]?\d+)", 1).try_cast("int")


def read_lenient(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Listings of all lines with enough fields; an empty quantity is 0, an empty text ``''``."""
    layout = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.RAW])
    layout.add(CORRUPT, T.StringType())
    lines = _read(spark, path, layout, encoding, "PERMISSIVE", header)
    enough = F.col(CORRUPT).isNull() | (_field_count(F.col(CORRUPT)) >= len(schema.RAW))
    return (
        lines.where(enough)
        .drop(CORRUPT)
        .withColumns({c: _leading_integer(F.col(c)) for c in schema.INT_COLUMNS})
        .fillna(0, ["available_quantity"])
        .fillna("", schema.TEXT_COLUMNS)
    )


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """Write listings in the layout the readers expect."""
    code_page = _is_code_page(encoding)
    if code_page:
        latin, own = _single_byte_overrides("cp1252")
        df = df.withColumns({c: F.translate(c, own, latin) for c in schema.TEXT_COLUMNS})
    df.write.mode("overwrite").options(
        header=True,
        quote='"',
        escape='"',
        nullValue="",
        emptyValue='""',
        encoding="ISO-8859-1" if code_page else encoding,
    ).csv(path)
    return path


def save_table(df: DataFrame, path: str) -> str:
    """Replace the columnar copy of the listings at ``path``; if that fails, the old one is still there.

    ``versions.replace`` does the same in one step for readers, and keeps what it replaces.
    """
    return write_table(df, path)
