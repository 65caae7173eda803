"""Event types, type weights and time weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
CLICKS, CARTS, ORDERS = 0, 1, 2
TYPE_IDS = {"clicks": CLICKS, "carts": CARTS, "orders": ORDERS}
TYPE_NAMES = {v: k for k, v in TYPE_IDS.items()}
TYPE_WEIGHTS = {CLICKS: 1, CARTS: 6, ORDERS: 3}
BUY_TYPES = (CARTS, ORDERS)
DAY = 86_400


def lookup(key: Column, table: Mapping, otherwise=None) -> Column:
    """``CASE key WHEN ...`` over a small fixed mapping."""
    items = iter(table.items())
    k, v = next(items)
    out = F.when(key == F.lit(k), F.lit(v))
    for k, v in items:
        out = out.when(key == F.lit(k), F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def is_buy(type_col: str | Column = "type") -> Column:
    return (F.col(type_col) if isinstance(type_col, str) else type_col).isin(*BUY_TYPES)


def type_weight(type_col: str | Column = "type", weights: Mapping[int, int] = TYPE_WEIGHTS) -> Column:
    return lookup(F.col(type_col) if isinstance(type_col, str) else type_col, weights)


def type_id(name_col: str | Column) -> Column:
    return lookup(F.col(name_col) if isinstance(name_col, str) else name_col, TYPE_IDS)


def type_name(id_col: str | Column) -> Column:
    return lookup(F.col(id_col) if isinstance(id_col, str) else id_col, TYPE_NAMES)


def time_weight(ts: str | Column, t0: int, t1: int) -> Column:
    """1 at ``t0`` rising linearly to 4 at ``t1``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.lit(1.0) + F.lit(3.0) * (ts - F.lit(t0)).cast("double") / F.lit(float(t1 - t0))


def position_weight(position: Column, length: Column, start: float) -> Column:
    """``2**(start + (1-start) * i / (L-1)) - 1`` for 0-based position i in a session of L events."""
    step = position.cast("double") / F.greatest(length - 1, F.lit(1)).cast("double")
    return F.pow(F.lit(2.0), F.lit(start) + F.lit(1.0 - start) * step) - F.lit(1.0)


# The value a rate takes when only its denominator is zero (fixed value of the feature set).
RATE_OVERFLOW = 100_000_000.0


def safe_rate(num: str | Column, den: str | Column) -> Column:
    """num/den, with 0/0 as 0 and x/0 as ``RATE_OVERFLOW``."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return (
        F.when(den != 0, num.cast("double") / den.cast("double"))
        .when(num == 0, F.lit(0.0))
        .otherwise(F.lit(RATE_OVERFLOW))
    )


def hash_bucket(seed: int, buckets: int, session: str | Column = "session", aid: str | Column | None = None) -> Column:
    """A reproducible pseudo-random bucket of a session or (session, aid) key.

    The first 60 bits of the MD5 of ``seed:session[:aid]``: well mixed also for ids in steps, and any SQL engine can repeat it.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in (session, aid) if k is not None]
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(buckets)
