"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its least node) for the nodes of ``edges`` (a, b: long), as a written table.

    Each round takes the least label among the neighbours and then follows the label's own label, so labels
    travel twice as far each round. Every round is written to the shared folder; the driver sees one count.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.put(both, f"{name}-edges")
    labels = scratch.put(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        lower = scratch.put(lower, f"{name}-lower-{k}")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = lower.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "further").alias("label"), "was")
        moved = scratch.put(moved, f"{name}-{k + 1}")
        changed = moved.filter("label <> was").limit(1).count()
        scratch.drop(f"{name}-{k}", f"{name}-lower-{k}")
        labels, k = moved.select("node", "label"), k + 1
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels.select("node", F.col("label").alias("component"))
