"""Count, rate and popularity features of items, sessions and candidate pairs.

Counts over all events and over the last n events of a session are kept apart: all-event counts combine
before the shuffle, and last-n rows are cut before it, so no session has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketweave.functions.events import TYPE_IDS, safe_rate
from basketweave.operators.recency import latest_events

LAST_ROWS = (3, 10, 30)
TYPES = tuple(TYPE_IDS)  # clicks, carts, orders
# Rates of one type per another, and differences of one type's count from another's.
RATE_PAIRS = (("carts", "clicks"), ("orders", "clicks"), ("orders", "carts"))


def count_type(name: str, condition: Column | None = None) -> Column:
    hit = F.col("type") == TYPE_IDS[name]
    if condition is not None:
        hit = hit & condition
    return F.count(F.when(hit, F.lit(1)))


def rate_columns(prefix: str = "", suffix: str = "") -> list[tuple[str, Column]]:
    """Six rates over the columns ``<prefix><type>_count<suffix>``."""
    count = {t: F.col(f"{prefix}{t}_count{suffix}") for t in TYPES}
    total = count["clicks"] + count["carts"] + count["orders"]
    out = [(f"{t}_rate_per_action{suffix}", safe_rate(count[t], total)) for t in TYPES]
    return out + [(f"{a}_rate_per_{b}{suffix}", safe_rate(count[a], count[b])) for a, b in RATE_PAIRS]


RATE_NAMES = tuple(f"{t}_rate_per_action" for t in TYPES) + tuple(f"{a}_rate_per_{b}" for a, b in RATE_PAIRS)
POPULARITY_NAMES = ("all_actions", *TYPES)


def average_ranks(items: DataFrame, counts: list[str]) -> DataFrame:
    """Adds ``rank_<c> = average rank of c / number of items`` for each count column.

    Equal counts share a rank, so ranks come from the histogram of each column: N events allow at most
    sqrt(2 N) different counts. The running sum is over that small table only. It joins back without a
    hint: Spark broadcasts it when its measured size allows, and splits the skewed side otherwise.
    """
    by_value = (
        items.select(F.posexplode(F.array(*[F.col(c).cast("long") for c in counts])).alias("metric", "value"))
        .groupBy("value")
        .agg(*[F.count(F.when(F.col("metric") == i, F.lit(1))).alias(f"n{i}") for i in range(len(counts))])
    )
    ascending = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    ranks = by_value.select(
        "value",
        F.array(
            *[
                (F.sum(f"n{i}").over(ascending) - (F.col(f"n{i}") - 1) / F.lit(2)) / F.sum(f"n{i}").over(everything)
                for i in range(len(counts))
            ]
        ).alias("ranks"),
    )
    out = items
    for i, c in enumerate(counts):
        one = ranks.select(F.col("value").alias(f"value_{i}"), F.col("ranks").alias(f"ranks_{i}"))
        out = out.join(one, F.col(c) == F.col(f"value_{i}"), "left").withColumn(
            f"rank_{c}", F.col(f"ranks_{i}")[i]
        ).drop(f"value_{i}", f"ranks_{i}")
    return out


def popularity(events: DataFrame, type_value: int | None = None) -> DataFrame:
    """Average rank of each item's event count, divided by the number of items."""
    hit = F.lit(True) if type_value is None else F.col("type") == type_value
    counts = events.groupBy("aid").agg(F.count(F.when(hit, F.lit(1))).alias("n"))
    return average_ranks(counts, ["n"]).select("aid", F.col("rank_n").alias("popularity"))


def features_item(events_all: DataFrame, events_recent: DataFrame) -> DataFrame:
    """30 columns per item of ``events_all``: rates and popularity overall, in the recent window, and their change."""
    tagged = events_all.select("aid", "type", F.lit(False).alias("recent")).unionByName(
        events_recent.select("aid", "type", F.lit(True).alias("recent"))
    )
    variants = {"": ~F.col("recent"), "_last1week": F.col("recent")}
    counts = (
        tagged.groupBy("aid")
        .agg(
            F.count(F.when(~F.col("recent"), F.lit(1))).alias("known"),
            *[count_type(t, cond).alias(f"{t}_count{s}") for s, cond in variants.items() for t in TYPES],
        )
        .where(F.col("known") > 0)
    )
    totals = [
        (F.col(f"clicks_count{s}") + F.col(f"carts_count{s}") + F.col(f"orders_count{s}")).alias(f"all_actions_count{s}")
        for s in variants
    ]
    counts = counts.select("*", *totals)
    ranked = average_ranks(counts, [f"{p}_count{s}" for s in variants for p in POPULARITY_NAMES])

    level = {}
    for s in variants:
        level.update(dict(rate_columns(suffix=s)))
        for p in POPULARITY_NAMES:
            level[f"popularity_{p}{s}"] = F.col(f"rank_{p}_count{s}")
    # rate_columns puts the suffix last, which is where the level names want it
    base = ranked.select("aid", *[c.alias(n) for n, c in level.items()])
    changes = []
    for p in POPULARITY_NAMES:
        short = "all" if p == "all_actions" else p
        changes.append(
            (F.col(f"popularity_{p}_last1week") - F.col(f"popularity_{p}")).alias(
                f"popularity_{short}_diff_from_all_to_last1week"
            )
        )
    changes += [
        (F.col(r) - F.col(f"{r}_last1week")).alias(f"{r}_diff_from_all_to_last1week") for r in RATE_NAMES
    ]
    return base.select("*", *changes)


def with_last_rows(events: DataFrame, n: int, *columns: str) -> DataFrame:
    """All events with ``recency`` null, plus the newest ``n`` of each session again with their recency."""
    return events.select(*columns, F.lit(None).cast("int").alias("recency")).unionByName(
        latest_events(events, n).select(*columns, "recency")
    )


def _row_sets() -> dict[str, Column]:
    """Which rows of ``with_last_rows`` count for "all" and for each last-n."""
    sets = {"all": F.col("recency").isNull()}
    sets.update({str(n): F.col("recency") <= n for n in LAST_ROWS})
    return sets


def features_session(events: DataFrame) -> DataFrame:
    """53 columns per session: counts and rates over all and the last 3/10/30 events, last type, changes."""
    suffix = {"all": "_of_session", **{str(n): f"_of_session_{n}" for n in LAST_ROWS}}
    aggs = [
        count_type(t, cond).alias(f"{t}_count{suffix[key]}") for key, cond in _row_sets().items() for t in TYPES
    ]
    counts = (
        with_last_rows(events, max(LAST_ROWS), "session", "type")
        .groupBy("session")
        .agg(*aggs, F.max(F.when(F.col("recency") == 1, F.col("type"))).alias("last_type_of_session"))
    )
    levels = []
    for key, s in suffix.items():
        total = F.col(f"clicks_count{s}") + F.col(f"carts_count{s}") + F.col(f"orders_count{s}")
        levels += [F.col(f"{t}_count{s}") for t in TYPES]
        levels.append(total.alias(f"total_action_count{s}"))
        levels += [c.alias(n) for n, c in rate_columns(suffix=s)]
        if key == "all":
            levels.append(F.col("last_type_of_session"))
    wide = counts.select("session", *levels)
    changes = [
        (F.col(f"{r}_of_session_3") - F.col(f"{r}_of_session_{n}")).alias(f"{r}_of_session_diff_3_{n}")
        for n in (10, 30)
        for r in RATE_NAMES
    ]
    return wide.select("*", *changes)


def candidates_rank() -> Column:
    """1-based rank of a merged candidate."""
    return (F.col("candidate_pos") + 1).alias("candidates_rank")


def features_session_item(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """34 columns per candidate: rank, counts of the item in the session over all and the last rows, trends.

    ``candidates`` brings ``candidate_pos`` from the merge; without it the rank column is left out.
    """
    name = {"all": "all", **{str(n): f"last{n}rows" for n in LAST_ROWS}}
    aggs = [count_type(t, cond).alias(f"{t}_count_{name[k]}") for k, cond in _row_sets().items() for t in TYPES]
    counts = with_last_rows(events, max(LAST_ROWS), "session", "aid", "type").groupBy("session", "aid").agg(*aggs)
    rank = [candidates_rank()] if "candidate_pos" in candidates.columns else []
    joined = candidates.select("session", "aid", *rank).join(counts, ["session", "aid"], "left")
    out = []
    for key in name.values():
        count = {t: F.coalesce(f"{t}_count_{key}", F.lit(0)).cast("int") for t in TYPES}
        out += [count[t].alias(f"{t}_count_{key}") for t in TYPES]
        out += [(count[a] - count[b]).alias(f"{a}_count_diff_from_{b}_{key}") for a, b in RATE_PAIRS]
    trend_steps = (("last3rows", "last10rows"), ("last10rows", "last30rows"), ("last30rows", "all"))
    filled = joined.select("session", "aid", *(["candidates_rank"] if rank else []), *out)
    trends = [
        (F.col(f"{t}_count_{a}") - F.col(f"{t}_count_{b}")).alias(f"{t}_count_diff_{a}_{b}")
        for t in TYPES
        for a, b in trend_steps
    ]
    return filled.select("*", *trends)
