"""Order within a session: newest events, last event, positions.

One session may hold a large part of the log. ``latest_events`` relies on the partial group limit that
Spark runs before the shuffle, so a session contributes at most n rows per input partition. Positions
need every row, so ``with_positions`` deals the log by ranges, which split any session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketweave.session import stage


def latest_events(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events of each session; ``recency`` is 1 for the newest."""
    newest_first = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("recency", F.row_number().over(newest_first)).where(F.col("recency") <= n)


def last_event(events: DataFrame) -> DataFrame:
    """Last item and type of each session."""
    return latest_events(events, 1).select("session", F.col("aid").alias("aid_last"), F.col("type").alias("type_last"))


def ranked_runs(events: DataFrame) -> DataFrame:
    """The log dealt by sampled ranges of (session, ts, event_id), with ``run`` (the range) and ``place`` in it.

    A session of any size, also within one second, is spread over as many ranges as it needs. The table is
    written, because the offsets of the runs must come from the very same ranges.
    """
    dealt = events.repartitionByRange("session", "ts", "event_id").withColumn("run", F.spark_partition_id())
    in_run = Window.partitionBy("session", "run").orderBy("ts", "event_id")
    return stage(dealt.withColumn("place", F.row_number().over(in_run)), "runs")


def with_positions(events: DataFrame) -> DataFrame:
    """Adds ``position`` (0-based, in time order) and ``session_length``.

    A running sum over the sizes of a session's runs gives the offset of each run: as many rows as the session
    has ranges.
    """
    # All columns but the keys travel as one, so that none of them meets a name used here.
    keys = ["session", "ts", "event_id"]
    rest = [c for c in events.columns if c not in keys]
    runs = ranked_runs(events.select(*keys, *([F.struct(*rest).alias("rest")] if rest else [])))
    sizes = runs.groupBy("session", "run").agg(F.max("place").alias("n"))
    by_session = Window.partitionBy("session")
    before = by_session.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "session",
        "run",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(by_session).cast("long").alias("session_length"),
    )
    position = (F.col("offset") + F.col("place") - 1).cast("long").alias("position")
    return runs.join(offsets, ["session", "run"]).select(
        *[F.col(f"rest.`{c}`") if c in rest else F.col(c) for c in events.columns], position, "session_length"
    )
