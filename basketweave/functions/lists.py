"""Text and array expressions of recommendation lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketweave.functions.events import TYPE_NAMES


def session_type(session: str, type_id: int) -> Column:
    return F.concat_ws("_", F.col(session).cast("string"), F.lit(TYPE_NAMES[type_id]))


def join_ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda a: a.cast("string")), " ")


def parse_session(session_type_col: str | Column) -> Column:
    return F.split(session_type_col, "_").getItem(0).cast("long")


def parse_ids(labels: str | Column, k: int) -> Column:
    """The first ``k`` ids of a space-joined list."""
    words = F.filter(F.split(labels, " "), lambda w: w != "")
    return F.transform(F.slice(words, 1, k), lambda w: w.cast("long"))
