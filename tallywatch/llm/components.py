"""Connected components of a link table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): label is the smallest node reachable.

    Each turn takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shorten fast. Sums and minima are taken
    before rows are shuffled, so a node with very many links is no hot spot.
    """
    both = stage(links.selectExpr("a", "b").unionByName(links.selectExpr("b AS a", "a AS b")).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.expr("least(a, min(b)) AS label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).selectExpr("node", "least(label, near) AS label", "label AS old")
        jump = labels.selectExpr("node AS label", "label AS further")
        moved = stage(
            lower.join(jump, "label", "left").selectExpr("node", "least(label, COALESCE(further, label)) AS label", "old"), "labels"
        )
        labels = moved.select("node", "label")
        if not moved.where("label < old").limit(1).count():
            return labels
