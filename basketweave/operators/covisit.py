"""Co-visitation edges: how often two items occur near each other in one session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketweave.functions.events import DAY, TYPE_WEIGHTS, is_buy, type_weight
from basketweave.operators.recency import latest_events


def _spread(events: DataFrame) -> DataFrame:
    """The cut events dealt by session over twice the usual number of parts.

    An event makes tens of pairs, so parts that are small as events must not be put together: a task's pairs would grow
    with the log. (With the usual number Spark would drop this exchange and put the parts together.)
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(2 * parts, "session")


def session_pairs(events: DataFrame, window_seconds: int, recent: int = 30) -> DataFrame:
    """Ordered item pairs of a session less than ``window_seconds`` apart.

    The session's newest ``recent`` events are gathered into one array, so a pair never needs a second
    shuffle and a session yields at most ``recent * (recent - 1)`` pairs whatever its size.
    """
    gathered = (
        _spread(latest_events(events, recent))
        .groupBy("session")
        .agg(F.collect_list(F.struct("aid", "ts", "type")).alias("items"))
    )
    x_side = gathered.select("session", F.explode("items").alias("x"), "items")
    return (
        x_side.select("session", "x", F.explode("items").alias("y"))
        .where((F.abs(F.col("x.ts") - F.col("y.ts")) < window_seconds) & (F.col("x.aid") != F.col("y.aid")))
        .select(
            "session",
            F.col("x.aid").alias("aid_x"),
            F.col("y.aid").alias("aid_y"),
            F.col("x.ts").alias("ts_x"),
            F.col("y.type").alias("type_y"),
        )
    )


def distinct_pairs(pairs: DataFrame, by: str) -> DataFrame:
    """One row per session, pair and ``by`` (``type_y`` or ``ts_x``)."""
    return pairs.select("session", "aid_x", "aid_y", by).distinct()


def sum_pairs(pairs: DataFrame, weight: Column) -> DataFrame:
    return pairs.groupBy("aid_x", "aid_y").agg(weight.alias("wgt"))


def top_edges(edges: DataFrame, k: int = 40) -> DataFrame:
    """The ``k`` heaviest neighbours of each item."""
    heaviest = Window.partitionBy("aid_x").orderBy(F.desc("wgt"), "aid_y")
    return (
        edges.withColumn("n", F.row_number().over(heaviest)).where(F.col("n") <= k).select("aid_x", "aid_y", "wgt")
    )


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Add uncut edge weights of disjoint sets of sessions. Cut with ``top_edges`` afterwards."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("aid_x", "aid_y").agg(F.sum("wgt").alias("wgt"))


def buy2buy_weights(events: DataFrame, window_seconds: int = 14 * DAY, recent: int = 30) -> DataFrame:
    pairs = session_pairs(events.where(is_buy()), window_seconds, recent)
    return sum_pairs(distinct_pairs(pairs, "type_y"), F.count(F.lit(1)))


def type_weights(
    events: DataFrame, window_seconds: int = DAY, weights: Mapping[int, int] = TYPE_WEIGHTS, recent: int = 30
) -> DataFrame:
    pairs = session_pairs(events, window_seconds, recent)
    return sum_pairs(distinct_pairs(pairs, "type_y"), F.sum(type_weight("type_y", weights)))


def time_weights(events: DataFrame, t0: int, t1: int, window_seconds: int = DAY, recent: int = 30) -> DataFrame:
    """Sum of ``1 + 3 (ts_x - t0) / (t1 - t0)``, summed in integers so that it does not depend on row order."""
    pairs = session_pairs(events, window_seconds, recent)
    seconds = F.sum(F.col("ts_x") - F.lit(t0)).cast("double")
    return sum_pairs(
        distinct_pairs(pairs, "ts_x"),
        F.count(F.lit(1)).cast("double") + F.lit(3.0) * seconds / F.lit(float(t1 - t0)),
    )


def day_weights(
    events: DataFrame,
    t0: int,
    t1: int,
    window_seconds: int = DAY,
    weights: Mapping[int, int] = TYPE_WEIGHTS,
    recent: int = 30,
) -> DataFrame:
    """``type_weights`` and ``time_weights`` from one pass: ``(aid_x, aid_y, wgt_type, wgt_time)``.

    Per session and pair, the distinct types of the second item are kept as bits and the distinct seconds of
    the first as count and sum. These steps stay in the session's partition, so the log is shuffled once and
    the pairs once for both weights.
    """
    pairs = session_pairs(events, window_seconds, recent)
    per_second = pairs.groupBy("session", "aid_x", "aid_y", "ts_x").agg(
        F.bit_or(F.expr("shiftleft(1, type_y)")).alias("types")
    )
    per_session = per_second.groupBy("session", "aid_x", "aid_y").agg(
        F.bit_or("types").alias("types"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("ts_x") - F.lit(t0)).alias("seconds"),
    )
    typed = [F.when(F.col("types").bitwiseAND(1 << t) != 0, w).otherwise(0) for t, w in weights.items()]
    summed = per_session.groupBy("aid_x", "aid_y").agg(
        F.sum(sum(typed[1:], typed[0])).alias("wgt_type"), F.sum("n").alias("n"), F.sum("seconds").alias("seconds")
    )
    time = F.col("n").cast("double") + F.lit(3.0) * F.col("seconds").cast("double") / F.lit(float(t1 - t0))
    return summed.select("aid_x", "aid_y", "wgt_type", time.alias("wgt_time"))


def covisit_buy2buy(events: DataFrame, window_seconds: int = 14 * DAY, recent: int = 30, k: int = 40) -> DataFrame:
    """Carts and orders only: number of (session, type) in which both items were bought."""
    return top_edges(buy2buy_weights(events, window_seconds, recent), k)


def covisit_type_weighted(
    events: DataFrame,
    window_seconds: int = DAY,
    weights: Mapping[int, int] = TYPE_WEIGHTS,
    recent: int = 30,
    k: int = 40,
) -> DataFrame:
    """All events, each pair weighted by the type of the second item."""
    return top_edges(type_weights(events, window_seconds, weights, recent), k)


def covisit_time_weighted(
    events: DataFrame, t0: int, t1: int, window_seconds: int = DAY, recent: int = 30, k: int = 40
) -> DataFrame:
    """All events, newer pairs weighing up to four times as much as the oldest."""
    return top_edges(time_weights(events, t0, t1, window_seconds, recent), k)
