from __future__ import annotations

import pytest
from pyspark.sql import Row

from tests.conftest import DATA

LAYOUT = "doc_id long, text string, lang string, score double, kept boolean, text_code string, chunk long"


def documents(spark, *rows: tuple):
    """Documents from (doc_id, text), with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.5, True, "x", 7) for i, t in rows], LAYOUT)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(corpus) -> dict[int, str]:
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and long texts, rows repeated in full, other texts under the same id."""
    long = " ".join(f"word{i}" for i in range(30_000))
    return documents(
        spark,
        (1, "one two three four five six seven eight nine ten"),
        (1, "one two three four five six seven eight nine ten"),
        (1, "another text under the same id"),
        (2, None),
        (3, ""),
        (None, "no id here"),
        (None, None),
        (4, " \n\t "),
        (5, "word"),
        (6, long),
        (7, long),
        (8, "é" * 3000),
        (9, "one two three four five six seven eight nine ten"),
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], LAYOUT)


def rows(df) -> list[Row]:
    return df.collect()
