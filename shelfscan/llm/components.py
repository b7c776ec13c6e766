"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.storage import store


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node and label, the smallest node reachable.

    Each round gives a node the smallest label among its neighbours and then the label of that
    label, so long chains shrink by half a round. Neighbours' labels are combined before the
    shuffle, so a node with very many links is no hot spot. Rounds are stored, which cuts the
    lineage; they end when no label changes.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = store(both, "links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        renewed = store(
            nearer.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "next"), "label").alias("label")),
            "labels",
        )
        labels = renewed.select("node", "label")
        if renewed.where("label <> old").isEmpty():
            return labels
