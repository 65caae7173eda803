"""Edges, candidates, features and training frames of one phase, written as tables under one root.

A phase has a full event log (history and recent week) and a recent log whose sessions get candidates.
The train phase also has labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basketweave.functions.events import DAY
from basketweave.operators import candidates as cand
from basketweave.operators import covisit as cv
from basketweave.operators import features as ft
from basketweave.operators import matrix_features as mx
from basketweave.operators import vector_features as vec
from basketweave.operators.learn import assemble_features
from basketweave.operators.recency import with_positions
from basketweave.operators.skipgram import train_skipgram
from basketweave.operators.vectors import reduce_vectors
from basketweave.session import stage
from basketweave.sources.tables import (
    EDGE_KINDS,
    load_candidates,
    load_covisit,
    load_item_vectors,
    save_csv,
    save_parquet,
)


# Feature tables by key.
ITEM = ("item", "vector_item")
SESSION = ("session", "vector_session")
PAIR = ("session_item", "matrix", "matrix_last")


@dataclass(frozen=True)
class Limits:
    """Cut-offs of the published run."""

    recent: int = 30
    edges_per_item: int = 40
    buy_window: int = 14 * DAY
    day_window: int = DAY
    session_items_clicks: int = 50
    additional: int = 120
    candidates: int = 100
    last_events: int = 5
    vector_size: int = 50
    vector_dims: int = 10


def build_edges(events: DataFrame, root: str, phase: str, t0: int, t1: int, limits: Limits = Limits()) -> None:
    """All three edge tables. The type- and time-weighted ones come from one pass over the log."""
    day = stage(cv.day_weights(events, t0, t1, limits.day_window, recent=limits.recent), "day-weights")
    tables = {
        "buy2buy": cv.covisit_buy2buy(events, limits.buy_window, limits.recent, limits.edges_per_item),
        "buys": cv.top_edges(day.withColumnRenamed("wgt_type", "wgt"), limits.edges_per_item),
        "clicks": cv.top_edges(day.withColumnRenamed("wgt_time", "wgt"), limits.edges_per_item),
    }
    for kind, df in tables.items():
        save_parquet(df, f"{root}/covisit/phase={phase}/kind={kind}")


def load_edges(spark: SparkSession, root: str, phase: str) -> dict[str, DataFrame]:
    return {kind: load_covisit(spark, root, phase, kind) for kind in EDGE_KINDS}


def build_candidates(events_recent: DataFrame, root: str, phase: str, limits: Limits = Limits()) -> None:
    """The click and the buy candidates."""
    edges = load_edges(events_recent.sparkSession, root, phase)
    positioned = stage(with_positions(events_recent), "positions")
    families = {
        "clicks": (
            cand.session_score_clicks(positioned, limits.session_items_clicks),
            cand.additional_clicks(events_recent, edges["clicks"], limits.additional),
        ),
        "buys": (
            cand.session_score_buys(positioned, edges["buy2buy"]),
            cand.additional_buys(events_recent, edges["buys"], edges["buy2buy"], limits.additional),
        ),
    }
    for family, (own, additional) in families.items():
        merged = cand.merge_candidates(own, additional, limits.candidates)
        path = f"{root}/candidates/phase={phase}/family={family}"
        save_parquet(merged, path)
        stored = events_recent.sparkSession.read.parquet(path).select("session", "aid")
        save_csv(cand.candidates_per_session(stored), f"{root}/reports/candidates-{phase}-{family}")


def build_item_vectors(events: DataFrame, root: str, phase: str, limits: Limits = Limits()) -> None:
    vectors = train_skipgram(events, limits.vector_size)
    save_parquet(reduce_vectors(stage(vectors, "vectors"), limits.vector_dims), f"{root}/item_vectors/phase={phase}")


def build_shared_features(events: DataFrame, events_recent: DataFrame, root: str, phase: str) -> None:
    """Item and session features, which all candidate types share."""
    spark = events.sparkSession
    vectors = load_item_vectors(spark, root, phase)
    tables = {
        "item": ft.features_item(events, events_recent),
        "session": ft.features_session(events_recent),
        "vector_item": vec.features_vector_item(vectors),
        "vector_session": vec.features_vector_session(events_recent, vectors),
    }
    for name, df in tables.items():
        save_parquet(df, f"{root}/features/phase={phase}/table={name}", checked=True)


def build_pair_features(events_recent: DataFrame, root: str, phase: str, limits: Limits = Limits()) -> None:
    """Features of all candidate pairs.

    Click and buy candidates overlap, so a pair's features are computed once for both; only the rank differs
    and is added by ``load_frame``, which also takes the differences of item and session vectors: they follow from columns that
    its rows have, and would be most of what is stored and shuffled here.
    """
    spark = events_recent.sparkSession
    clicks, buys = (load_candidates(spark, root, phase, t) for t in (0, 1))
    pairs = stage(clicks.unionByName(buys).distinct(), "pairs")
    edges = load_edges(spark, root, phase)
    scale = mx.TEST_PHASE_SCALE if phase == "test" else 1.0
    features = f"{root}/features/phase={phase}"
    tables = {
        "session_item": ft.features_session_item(pairs, events_recent),
        "matrix": mx.features_matrix(pairs, events_recent, edges, limits.last_events, scale),
        "matrix_last": mx.features_matrix_last(pairs, events_recent, edges, scale),
    }
    for name, df in tables.items():
        save_parquet(df, f"{features}/table={name}", checked=True)


def load_frame(
    spark: SparkSession, root: str, phase: str, type_id: int, labels: DataFrame | None = None, flags: bool = False
) -> DataFrame:
    """Candidates of one type with target and all features; with ``flags`` also what is missing (see ``learn.attach``)."""
    base = load_candidates(spark, root, phase, type_id, ("session", "aid", "candidate_pos")).select(
        "session", "aid", ft.candidates_rank()
    )
    table = {t: spark.read.parquet(f"{root}/features/phase={phase}/table={t}") for t in ITEM + SESSION + PAIR}
    frame = assemble_features(
        cand.label_candidates(base, type_id, labels),
        item=[table[t] for t in ITEM],
        session=[table[t] for t in SESSION],
        pair=[table[t] for t in PAIR],
        flags=flags,
    )
    return frame.select("*", *vec.pair_differences(vec.dimensions(table["vector_item"], "_candidates")))


def build_phase(
    events: DataFrame,
    events_recent: DataFrame,
    root: str,
    phase: str,
    t0: int,
    t1: int,
    limits: Limits = Limits(),
    vectors: DataFrame | None = None,
) -> None:
    """Every table of a phase. Given ``vectors`` replace the trained ones."""
    build_edges(events, root, phase, t0, t1, limits)
    build_candidates(events_recent, root, phase, limits)
    if vectors is None:
        build_item_vectors(events, root, phase, limits)
    else:
        save_parquet(vectors, f"{root}/item_vectors/phase={phase}")
    build_shared_features(events, events_recent, root, phase)
    build_pair_features(events_recent, root, phase, limits)
