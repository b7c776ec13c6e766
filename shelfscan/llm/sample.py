"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out and never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Up to ``rows`` labelled ids outside fold 0 with their label (doc_id, label).

    The ids with the smallest hashes are taken, so the choice depends on neither partitioning
    nor order. Ids with contradicting labels or without any are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def one_text_each(examples: DataFrame) -> DataFrame:
    """``examples`` (doc_id, code, and more) with one row for each doc_id, that of the smallest code.

    Rows are reduced in each task first, so an id that holds much of the table sends few rows.
    """
    rest = [c for c in examples.columns if c not in ("doc_id", "code")]
    least = examples.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "code").alias("x"))
    return least.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in rest])
