"""Recommendation lists and their evaluation against held-out labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketweave.functions.events import TYPE_IDS, TYPE_NAMES
from basketweave.functions.lists import join_ids, parse_ids, parse_session, session_type

# Fixed values of the evaluation and of the output format.
SCORE_WEIGHTS = {"clicks": 0.10, "carts": 0.30, "orders": 0.60}
LIST_SIZE = 40
TEXT_LIMIT = 320


def top_scored(scores: DataFrame, k: int = LIST_SIZE) -> DataFrame:
    best = Window.partitionBy("session").orderBy(F.desc_nulls_last("score"), "aid")
    return scores.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


def make_recommendations(scores: DataFrame, type_value: int, k: int = LIST_SIZE) -> DataFrame:
    """``(session_type, labels)``: the ``k`` best items of each session, best first, space-joined."""
    ranked = top_scored(scores, k).groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("n", "aid"))).alias("ranked")
    )
    return ranked.select(
        session_type("session", type_value).alias("session_type"),
        join_ids(F.transform("ranked", lambda r: r["aid"])).alias("labels"),
    )


def _hits(recommendations: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Hits and possible hits per label row; a label without recommendations has zero hits."""
    predicted = recommendations.select(
        parse_session("session_type").alias("session"),
        F.split("session_type", "_").getItem(1).alias("type"),
        parse_ids("labels", k).alias("predicted"),
    )
    joined = labels.join(predicted, ["session", "type"], "left")
    found = F.size(F.array_intersect(F.col("ground_truth").cast("array<bigint>"), F.col("predicted")))
    return joined.select(
        "session",
        "type",
        F.when(F.col("predicted").isNull(), 0).otherwise(found).alias("hits"),
        F.least(F.size("ground_truth"), F.lit(k)).alias("gt_count"),
    )


def recall_by_type(recommendations: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """``(type, hits, gt_count, recall)`` for every label type, in one aggregation."""
    return (
        _hits(recommendations, labels, k)
        .groupBy("type")
        .agg(F.sum("hits").alias("hits"), F.sum("gt_count").alias("gt_count"))
        .withColumn("recall", F.when(F.col("gt_count") > 0, F.col("hits") / F.col("gt_count")).otherwise(F.lit(0.0)))
    )


def recall_at(recommendations: DataFrame, labels: DataFrame, type_value: int, k: int = 20) -> DataFrame:
    name = TYPE_NAMES[type_value]
    of_type = recommendations.where(F.col("session_type").contains(name))
    return recall_by_type(of_type, labels.where(F.col("type") == name), k)


def weighted_score(
    recommendations: DataFrame, labels: DataFrame, k: int = 20, weights: Mapping[str, float] = SCORE_WEIGHTS
) -> DataFrame:
    """One row: recall of each type and their weighted sum."""
    recalls = recall_by_type(recommendations, labels, k)
    per_type = recalls.agg(
        *[F.coalesce(F.max(F.when(F.col("type") == t, F.col("recall"))), F.lit(0.0)).alias(t) for t in TYPE_IDS]
    )
    total = sum((F.col(t) * F.lit(weights[t]) for t in TYPE_IDS), F.lit(0.0))
    return per_type.select(*[F.col(t).alias(f"recall_{t}") for t in TYPE_IDS], total.alias("score"))


def whole_ids(labels: Column, limit: int) -> Column:
    """As many whole ids of a space-joined list as fit in ``limit`` characters."""
    cut = F.regexp_replace(F.substring(F.concat(labels, F.lit(" ")), 1, limit + 1), " [^ ]*$", "")
    return F.when(F.length(labels) <= limit, labels).otherwise(cut)


def concat_submissions(clicks: DataFrame, carts: DataFrame, orders: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """One sorted submission; cart and order lists are cut at ``limit`` characters, between ids."""
    parts = []
    for df, name in ((clicks, "clicks"), (carts, "carts"), (orders, "orders")):
        labels = F.col("labels") if name == "clicks" else whole_ids(F.col("labels"), limit)
        parts.append(df.where(F.col("session_type").contains(name)).select("session_type", labels.alias("labels")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("session_type")
