"""Output checks and narrow storage types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
# Open value ranges of the storage types, smallest first.
_INT_RANGES = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))
_FLOAT32_MAX = 3.4028234663852886e38


def _fractional(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, _FRACTIONAL)}


def quality_aggregates(df: DataFrame) -> list[Column]:
    """Counts of null (or NaN) and infinite values of every column."""
    fractional = _fractional(df)
    aggs = []
    for c in df.columns:
        bad = F.isnull(c) | F.isnan(c) if c in fractional else F.isnull(c)
        aggs.append(F.count(F.when(bad, F.lit(1))).alias(f"null_{c}"))
        if c in fractional:
            aggs.append(F.count(F.when(F.abs(c) == float("inf"), F.lit(1))).alias(f"inf_{c}"))
    return aggs


def quality_report(df: DataFrame) -> DataFrame:
    """``(column, nulls, infinite)`` for every column, from one aggregation."""
    fractional = _fractional(df)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"null_{c}").alias("nulls"),
            (F.col(f"inf_{c}") if c in fractional else F.lit(0).cast("long")).alias("infinite"),
        )
        for c in df.columns
    ]
    return df.agg(*quality_aggregates(df)).select(F.inline(F.array(*rows)))


def raise_if_bad(counts: dict) -> None:
    """Raise if any count of ``quality_aggregates`` is not zero."""
    bad = sorted({name.split("_", 1)[1] for name, n in counts.items() if name.startswith(("null_", "inf_")) and n})
    if bad:
        raise ValueError("null or infinite features: " + ", ".join(bad))


def assert_clean(df: DataFrame) -> DataFrame:
    """Raise if any value is null, NaN or infinite; otherwise return ``df``."""
    raise_if_bad(df.agg(*quality_aggregates(df)).first().asDict())
    return df


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast each numeric column to the smallest type whose open range holds its values.

    Integers go to tinyint, smallint or int; fractions to float. One aggregation finds all ranges.
    """
    numeric = [f for f in df.schema if isinstance(f.dataType, _INTEGRAL + _FRACTIONAL)]
    if not numeric:
        return df
    low_high = df.agg(
        *[F.min(f.name).alias(f"lo_{i}") for i, f in enumerate(numeric)],
        *[F.max(f.name).alias(f"hi_{i}") for i, f in enumerate(numeric)],
    ).first()
    target = {}
    for i, f in enumerate(numeric):
        lo, hi = low_high[f"lo_{i}"], low_high[f"hi_{i}"]
        if lo is None:
            continue
        if isinstance(f.dataType, _INTEGRAL):
            fits = [name for name, top in _INT_RANGES if lo > -top and hi < top - 1]
            target[f.name] = fits[0] if fits else "bigint"
        elif -_FLOAT32_MAX < lo and hi < _FLOAT32_MAX:
            target[f.name] = "float"
    return df.select(*[F.col(c).cast(target[c]).alias(c) if c in target else F.col(c) for c in df.columns])
