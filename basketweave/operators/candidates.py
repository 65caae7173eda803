"""Candidate items per session: scored session items, expansion through edges, fillers, merge, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketweave.functions.events import (
    BUY_TYPES,
    CARTS,
    CLICKS,
    ORDERS,
    is_buy,
    position_weight,
    type_id,
    type_weight,
)
from basketweave.operators.recency import with_positions

BUY2BUY_BONUS = 0.1

#: Decimals of a session score that decide its place.
SCORE_DIGITS = 9


def _positioned(events: DataFrame) -> DataFrame:
    """Events with positions; a log that has them already is used as it is."""
    return events if "position" in events.columns else with_positions(events)


def expand_by_edges(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of each (session, aid): one row per matching edge.

    An item without edges gives no row. An item that is in a large part of all sessions makes one join
    partition large; the join feeds a new shuffle, so AQE is free to split that partition.
    """
    return items.join(edges, items["aid"] == edges["aid_x"]).select("session", "aid_y", "wgt")


def session_score_buys(events: DataFrame, buy2buy: DataFrame) -> DataFrame:
    """Session items scored for carts and orders.

    Type weight times position weight, plus a bonus per buy2buy edge that leads from an item bought in the
    session to an item of the session. Both parts meet in one aggregation, not in a join.
    """
    weighted = _positioned(events).select(
        "session",
        "aid",
        (type_weight() * position_weight(F.col("position"), F.col("session_length"), 0.5)).alias("score"),
        F.lit(0).alias("hits"),
        F.lit(1).alias("present"),
    )
    bought = events.where(is_buy()).select("session", "aid").distinct()
    bonus = expand_by_edges(bought, buy2buy).select(
        "session", F.col("aid_y").alias("aid"), F.lit(0.0).alias("score"), F.lit(1).alias("hits"), F.lit(0).alias("present")
    )
    return (
        weighted.unionByName(bonus)
        .groupBy("session", "aid")
        .agg(F.sum("score").alias("score"), F.sum("hits").alias("hits"), F.max("present").alias("present"))
        .where(F.col("present") == 1)
        .select("session", "aid", (F.col("score") + F.lit(BUY2BUY_BONUS) * F.col("hits")).alias("session_score"))
    )


def session_score_clicks(events: DataFrame, max_n: int = 50) -> DataFrame:
    """Session items scored for clicks, with presence flags; the ``max_n`` most recently seen are kept."""
    score = type_weight() * position_weight(F.col("position"), F.col("session_length"), 0.1)
    scored = (
        _positioned(events)
        .groupBy("session", "aid")
        .agg(
            F.sum(score).alias("session_score"),
            F.max("session_length").alias("session_length"),
            F.max("ts").alias("last_event_ts"),
            *[
                F.max((F.col("type") == t).cast("int")).alias(name)
                for t, name in ((CLICKS, "exists_clicks"), (CARTS, "exists_carts"), (ORDERS, "exists_orders"))
            ],
        )
    )
    newest = Window.partitionBy("session").orderBy(F.desc("last_event_ts"), "aid")
    return scored.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= max_n).drop("n")


def top_items(events: DataFrame, type_value: int, n: int) -> DataFrame:
    """The ``n`` items with most events of one type, as ``(aid, rank)`` with rank from 1."""
    counts = events.where(F.col("type") == type_value).groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "aid").limit(n)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "aid"))).alias("items"))
    return ordered.select(F.posexplode("items").alias("pos", "item")).select(
        F.col("item.aid").alias("aid"), (F.col("pos") + 1).alias("rank")
    )


def _ranked_array(top: DataFrame) -> Column:
    """The (at most n) ranked items as one array, read by a scalar subquery."""
    ordered = top.agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("items"))
    return ordered.select(F.transform("items", lambda i: i["aid"])).scalar()


def limited_sessions(events: DataFrame, n: int) -> DataFrame:
    """Distinct ``(session, aid, bought)`` of sessions with fewer than ``n`` distinct items.

    Each session is first cut to ``n`` distinct items, which is enough to tell that it has too many. Keys are
    filtered here, so that consumers joining on either of them share one exchange.
    """
    known = events.where(F.isnotnull("session") & F.isnotnull("aid"))
    items = known.groupBy("session", "aid").agg(F.max(F.col("type").isin(*BUY_TYPES)).alias("bought"))
    by_session = Window.partitionBy("session")
    return (
        items.withColumn("k", F.row_number().over(by_session.orderBy("aid")))
        .where(F.col("k") <= n)
        .withColumn("size", F.count(F.lit(1)).over(by_session))
        .where(F.col("size") < n)
        .select("session", "aid", "bought")
    )


def _top_hits(hits: DataFrame, n: int) -> DataFrame:
    counted = hits.groupBy("session", "aid_y").agg(F.count(F.lit(1)).alias("wgt"))
    most = Window.partitionBy("session").orderBy(F.desc("wgt"), "aid_y")
    return (
        counted.withColumn("k", F.row_number().over(most))
        .where(F.col("k") <= n)
        .select("session", F.col("aid_y").alias("aid"), "wgt")
    )


def _fill_up(own: DataFrame, added: DataFrame, top: DataFrame, n: int, first_rank: int) -> DataFrame:
    """Complete each session to ``n`` rows with top items that are neither in it nor added.

    Fillers carry ``wgt = -rank`` so that they sort behind the added items. Own items, added items and the
    top list are bounded arrays, so only the rows that are needed come into being.
    """
    # The same columns as in the edge join, which lets Spark reuse the exchange.
    own_lists = own.groupBy("session").agg(F.collect_list(F.struct(*own.columns[1:])).alias("own"))
    added_lists = added.groupBy("session").agg(F.collect_list(F.struct("aid", "wgt")).alias("added"))
    none = F.array().cast(added_lists.schema["added"].dataType)
    taken = F.array_union(F.transform("own", lambda i: i["aid"]), F.transform("added", lambda a: a["aid"]))
    filler = lambda a, i: F.struct(a.alias("aid"), (-(i + first_rank)).cast("long").alias("wgt"))
    completed = (
        own_lists.join(added_lists, "session", "left")
        .withColumn("added", F.coalesce("added", none))
        .withColumn(
            "fill", F.slice(F.array_except(_ranked_array(top), taken), F.lit(1), F.lit(n) - F.size("added"))
        )
        .select("session", F.explode(F.concat("added", F.transform("fill", filler))).alias("c"))
    )
    return completed.select("session", "c.aid", "c.wgt")


def top_fillers(events: DataFrame, type_value: int, n: int) -> DataFrame:
    """For every session the ``n`` top items of one type that it does not have, with ``wgt`` from -1 downwards.

    Sessions of any size take part; of a session's items only those on the top list are gathered.
    """
    top = _ranked_array(top_items(events, type_value, n))
    listed = events.where(F.isnotnull("session")).select("session", F.when(F.array_contains(top, F.col("aid")), F.col("aid")).alias("aid"))
    own = listed.groupBy("session").agg(F.collect_set("aid").alias("own"))
    fill = own.select("session", F.posexplode(F.array_except(top, "own")).alias("k", "aid"))
    return fill.select("session", "aid", (-(F.col("k") + 1)).cast("long").alias("wgt"))


def additional_clicks(events: DataFrame, edges: DataFrame, n: int = 120) -> DataFrame:
    """Items from outside the session for clicks: most edge hits first, then the most clicked items."""
    own = limited_sessions(events, n).drop("bought")
    added = _top_hits(expand_by_edges(own, edges), n)
    return _fill_up(own, added, top_items(events, CLICKS, n), n, first_rank=1)


def additional_buys(events: DataFrame, type_edges: DataFrame, buy_edges: DataFrame, n: int = 120) -> DataFrame:
    """As ``additional_clicks`` for carts and orders.

    All session items expand through the type-weighted edges, bought items also through the buy2buy edges
    (one join over both kinds); fillers come from the 1.5 n most ordered items.
    """
    own = limited_sessions(events, n)
    edges = type_edges.select("aid_x", "aid_y", F.lit(False).alias("buys_only")).unionByName(
        buy_edges.select("aid_x", "aid_y", F.lit(True).alias("buys_only"))
    )
    hits = (
        own.join(edges, own["aid"] == edges["aid_x"])
        .where(F.col("bought") | ~F.col("buys_only"))
        .select("session", "aid_y")
    )
    return _fill_up(own, _top_hits(hits, n), top_items(events, ORDERS, int(1.5 * n)), n, first_rank=0)


def anti_existing(additional: DataFrame, session_candidates: DataFrame) -> DataFrame:
    """Additional candidates that are not items of the session already."""
    return additional.join(session_candidates.select("session", "aid"), ["session", "aid"], "left_anti")


def merge_candidates(session_candidates: DataFrame, additional: DataFrame, n: int | None = 100) -> DataFrame:
    """Session items by score, then additional items by weight; ``candidate_pos`` counts from 0. ``n=None`` keeps all.

    An additional item that is in the session already gives way. Both inputs hold a (session, aid) once, so one
    aggregation over their union decides that and reads each input once.
    """
    union = session_candidates.select("session", "aid", "session_score").unionByName(
        additional.select("session", "aid", "wgt"), allowMissingColumns=True
    )
    unique = (
        union.groupBy("session", "aid")
        .agg(F.max("session_score").alias("session_score"), F.max("wgt").alias("wgt"))
        .withColumn("wgt", F.when(F.isnull("session_score"), F.col("wgt")))
    )
    # Scores are sums of doubles in shuffle order; rounding keeps their last bits out of the order.
    best = Window.partitionBy("session").orderBy(
        F.round("session_score", SCORE_DIGITS).desc_nulls_last(), F.desc_nulls_last("wgt"), "aid"
    )
    cut = unique.withColumn("place", F.row_number().over(best))
    if n is not None:
        cut = cut.where(F.col("place") <= n)
    return cut.select("session", "aid", "session_score", "wgt", (F.col("place") - 1).alias("candidate_pos"))


def candidates_per_session(candidates: DataFrame) -> DataFrame:
    """Distribution of the number of distinct candidates of a session."""
    sizes = candidates.distinct().groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    quantiles = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return sizes.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("n").alias("mean"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std"),
        F.min("n").alias("min"),
        quantiles.alias("q"),
        F.max("n").alias("max"),
    ).select(
        "count",
        "mean",
        "std",
        "min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))],
        "max",
    )


def explode_labels(labels: DataFrame) -> DataFrame:
    """One row per true item: ``(session, type, aid, target=1)``."""
    return (
        labels.select("session", type_id("type").alias("type"), F.explode("ground_truth").alias("aid"))
        .distinct()
        .withColumn("target", F.lit(1))
    )


def label_candidates(candidates: DataFrame, type_value: int, labels: DataFrame | None = None) -> DataFrame:
    """Adds ``type`` and ``target``. Without labels (the test phase) every target is 0."""
    base = candidates.withColumn("type", F.lit(type_value))
    if labels is None:
        return base.withColumn("target", F.lit(0).cast("byte"))
    truth = explode_labels(labels).where(F.col("type") == type_value).select("session", "aid", "target")
    return base.join(truth, ["session", "aid"], "left").select(
        *base.columns, F.coalesce("target", F.lit(0)).cast("byte").alias("target")
    )
