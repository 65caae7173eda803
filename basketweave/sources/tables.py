"""Parquet and CSV tables: event logs, labels, edges, candidates, vectors, submissions, features.

Tables that exist per phase are stored under ``<root>/<name>/phase=<phase>``; edge tables also carry
``kind=<kind>``, so phase and kind are pruned as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketweave.operators.quality import quality_aggregates, raise_if_bad
from basketweave.session import delete_folder, replace_folder

EVENT_COLUMNS = ("session", "aid", "ts", "type", "event_id")
PHASES = ("train", "test")
EDGE_KINDS = ("buy2buy", "buys", "clicks")
SUBMISSION_SCHEMA = "session_type STRING, labels STRING"


def _check(value, allowed, what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {list(allowed)}, got {value!r}")


def as_events(df: DataFrame) -> DataFrame:
    """The event-log columns, with a tie-break for events of one session at the same second.

    A log without ``event_id`` gets a hash of its four columns: rows that still tie are identical,
    so every ordered operator stays deterministic.
    """
    if "event_id" not in df.columns:
        df = df.withColumn("event_id", F.xxhash64("session", "aid", "ts", "type"))
    return df.select(*EVENT_COLUMNS)


def load_events(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more event logs as one table (history and recent week of a phase)."""
    frames = [as_events(spark.read.parquet(p)) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("session", "type", "ground_truth")


def load_covisit(spark: SparkSession, root: str, phase: str, kind: str) -> DataFrame:
    """Edges of one kind, however many part files were written."""
    _check(phase, PHASES, "phase")
    _check(kind, EDGE_KINDS, "kind")
    return spark.read.parquet(f"{root}/covisit/phase={phase}/kind={kind}").select("aid_x", "aid_y", "wgt")


def candidate_family(type_id: int) -> str:
    """Carts and orders share one candidate table."""
    _check(type_id, (0, 1, 2), "type_id")
    return "clicks" if type_id == 0 else "buys"


def load_candidates(spark: SparkSession, root: str, phase: str, type_id: int, columns=("session", "aid")) -> DataFrame:
    _check(phase, PHASES, "phase")
    return spark.read.parquet(f"{root}/candidates/phase={phase}/family={candidate_family(type_id)}").select(*columns)


def load_item_vectors(spark: SparkSession, root: str, phase: str) -> DataFrame:
    _check(phase, PHASES, "phase")
    return spark.read.parquet(f"{root}/item_vectors/phase={phase}")


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite", checked: bool = False) -> dict:
    """Write and return ``{"rows": n}``, counted while writing rather than by a second job.

    ``checked`` also counts null and infinite values on the way and raises if there are any. The rows are then
    written beside ``path`` first, so that a bad table never takes the place of a good one.
    """
    seen, spark = Observation(), df.sparkSession
    if not checked:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
        return {"rows": seen.get["rows"]}
    if mode != "overwrite":
        raise ValueError("a checked table replaces what was there: mode must be overwrite")
    new = f"{path.rstrip('/')}__new"
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *quality_aggregates(df)).write.mode("overwrite").parquet(new)
    try:
        raise_if_bad(seen.get)
    except ValueError:
        delete_folder(spark, new)
        raise
    replace_folder(spark, new, path)
    return {"rows": seen.get["rows"]}


def save_bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A bucketed, sorted table: later joins on ``keys`` read it without an exchange."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> dict:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).csv(path, header=True)
    return seen.get


def load_submission(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(SUBMISSION_SCHEMA).csv(list(paths), header=True)
