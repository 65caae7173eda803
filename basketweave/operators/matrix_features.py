"""Features of a candidate from the edges that lead to it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketweave.operators.recency import last_event, latest_events

KINDS = ("buys", "buy2buy", "clicks")
TEST_PHASE_SCALE = 7 / 9  # 3.5 weeks of training log against 4.5 weeks in the test phase


def tag_edges(edges: Mapping[str, DataFrame]) -> DataFrame:
    """The edge tables as one table with a ``kind`` column."""
    out = None
    for kind, df in edges.items():
        part = df.select(F.lit(kind).alias("kind"), "aid_x", "aid_y", F.col("wgt").cast("double").alias("wgt"))
        out = part if out is None else out.unionByName(part)
    return out


def scale_columns(df: DataFrame, factor: float, keys: tuple[str, ...] = ("session", "aid")) -> DataFrame:
    """Multiply every feature column by ``factor``."""
    if factor == 1.0:
        return df
    return df.select(*keys, *[(F.col(c) * F.lit(factor)).alias(c) for c in df.columns if c not in keys])


def item_repeats(events: DataFrame, last: int) -> DataFrame:
    """How often each item occurs in a session: over all events and among the last ``last``."""
    tagged = events.select("session", "aid", F.lit(1).alias("n_all"), F.lit(0).alias("n_last")).unionByName(
        latest_events(events, last).select("session", "aid", F.lit(0).alias("n_all"), F.lit(1).alias("n_last"))
    )
    return tagged.groupBy("session", "aid").agg(F.sum("n_all").alias("n_all"), F.sum("n_last").alias("n_last"))


def edge_hits(candidates: DataFrame, events: DataFrame, edges: DataFrame, last: int) -> DataFrame:
    """Every candidate with the edges from session items to it, and how often the source item occurs.

    The list of a session's candidates (at most as many as a merge keeps) travels with its items, so edges to
    anything else are dropped where they are found and never shuffled.
    """
    wanted = candidates.groupBy("session").agg(F.collect_set("aid").alias("wanted"))
    repeats = item_repeats(events, last).join(wanted, "session")
    reached = repeats.join(edges, (repeats["aid"] == edges["aid_x"]) & F.array_contains("wanted", F.col("aid_y"))).select(
        "session", F.col("aid_y").alias("aid"), "kind", "wgt", "n_all", "n_last"
    )
    return candidates.select("session", "aid").join(reached, ["session", "aid"], "left")


def features_matrix(
    candidates: DataFrame, events: DataFrame, edges: Mapping[str, DataFrame], last: int = 5, scale: float = 1.0
) -> DataFrame:
    """Mean, min, max, median and sum of edge weights per candidate and edge kind, 15 over all events of the
    session and 15 over its last ``last``.

    An item that occurs n times counts n times. Its edges are joined once and weighted by n; the median is
    found in the running sum of n, which sorts and spills rather than holding a group in memory. Join,
    running sums and aggregation share one partitioning by (session, aid).
    """
    hits = edge_hits(candidates, events, tag_edges(edges), last)
    group = Window.partitionBy("session", "aid", "kind")
    running = group.orderBy("wgt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    variants = {"all": "n_all", str(last): "n_last"}
    summed = hits.select(
        "*",
        *[F.sum(n).over(running).alias(f"{n}_upto") for n in variants.values()],
        *[F.sum(n).over(group).alias(f"{n}_total") for n in variants.values()],
    )
    aggs = []
    for label, n in variants.items():
        for kind in KINDS:
            mine = (F.col("kind") == kind) & (F.col(n) > 0)
            upto = 2 * F.col(f"{n}_upto")
            aggs += [
                F.sum(F.when(mine, F.col("wgt") * F.col(n))).alias(f"sum_{kind}_{label}"),
                F.sum(F.when(mine, F.col(n))).alias(f"n_{kind}_{label}"),
                F.min(F.when(mine, F.col("wgt"))).alias(f"min_{kind}_{label}"),
                F.max(F.when(mine, F.col("wgt"))).alias(f"max_{kind}_{label}"),
                F.min(F.when(mine & (upto >= F.col(f"{n}_total")), F.col("wgt"))).alias(f"low_{kind}_{label}"),
                F.min(F.when(mine & (upto > F.col(f"{n}_total")), F.col("wgt"))).alias(f"high_{kind}_{label}"),
            ]
    grouped = summed.groupBy("session", "aid").agg(*aggs)

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    out = []
    for label in variants:
        for kind in KINDS:
            key = f"{kind}_{label}"
            out += [
                zero(F.col(f"sum_{key}") / F.col(f"n_{key}")).alias(f"wgt_{kind}_mean_{label}"),
                zero(F.col(f"min_{key}")).alias(f"wgt_{kind}_min_{label}"),
                zero(F.col(f"max_{key}")).alias(f"wgt_{kind}_max_{label}"),
                zero((F.col(f"low_{key}") + F.col(f"high_{key}")) / 2).alias(f"wgt_{kind}_median_{label}"),
                zero(F.col(f"sum_{key}")).alias(f"wgt_{kind}_sum_last{label}"),
            ]
    return scale_columns(grouped.select("session", "aid", *out), scale)


def features_matrix_last(
    candidates: DataFrame, events: DataFrame, edges: Mapping[str, DataFrame], scale: float = 1.0
) -> DataFrame:
    """Integer part of the weight of the edge from the session's last item to the candidate, per edge kind."""
    # One row per session meets the edges of its last item (a bounded list), by item alone: both sides have an
    # exchange, so Spark can split the sessions that end on a popular item. Candidates are met by session after that.
    tagged = tag_edges(edges)
    ends = last_event(events).select("session", "aid_last")
    reached = (
        ends.join(tagged, ends["aid_last"] == tagged["aid_x"])
        .groupBy("session", F.col("aid_y").alias("aid"))
        .agg(*[F.max(F.when(F.col("kind") == k, F.col("wgt"))).alias(k) for k in KINDS])
    )
    joined = candidates.select("session", "aid").join(reached, ["session", "aid"], "left")
    weights = [F.coalesce(F.col(k), F.lit(0.0)).cast("long").alias(f"cvm_weight_{k}_last1") for k in KINDS]
    return scale_columns(joined.select("session", "aid", *weights), scale)
