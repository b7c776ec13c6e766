"""The operators applied to their whole tables with production parameters; their SQL is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan.llm import bpe, fair_mix, importance, near_dedup, order_minhash, packing, prefix_trie, pseudonyms, quality, repeats, templates, toxicity, warc
from shelfscan.llm.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES", "TEST_KEY", "table"]

#: The key of the queries and of tests in sessions that set no other; a real run sets pseudonyms.KEY_SETTING.
TEST_KEY = "shelfscan"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"), order_minhash.words_or_pieces)


def op3_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.drop("text_code", "first")


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(documents, pseudonyms.session_key(spark, TEST_KEY))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_code")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # reads this module too

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_order_minhash,
        op3_min_max_dedup,
        op4_site_templates,
        op5_packing,
        op6_pseudonyms,
        op7_byte_bpe,
        op8_warc,
        op9_repeats,
        op10_toxicity,
        op11_fair_mix,
        op12_importance,
        op13_prefix_trie,
        pipeline,
    )
}
