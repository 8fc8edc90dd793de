"""Connected components by hash-min with pointer jumping, all of it in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.materialize import checkpoint


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the least node of its component.

    Each round takes the least label among a node and its neighbours and then the label of
    that label, so long chains shrink geometrically. Every round is checkpointed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = checkpoint(both.distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        near = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "_near").alias("_new"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = near.join(up, F.col("_new") == F.col("_n"), "left").select("node", F.col("label").alias("_old"), F.least("_new", "_up").alias("label"))
        jumped = checkpoint(jumped)
        labels = jumped.select("node", "label")
        if not jumped.where(F.col("label") != F.col("_old")).limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
