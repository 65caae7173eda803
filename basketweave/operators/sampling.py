"""Folds, down-sampling and row order of training frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketweave.functions.events import hash_bucket

HASH_RANGE = 1_000_003


def group_kfold(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``; all rows of a session share it."""
    return df.withColumn("fold", hash_bucket(seed, folds).cast("int"))


def negative_share(pos, n, rate: float):
    """Share of the negatives to keep for ``rate`` negatives per positive; numbers or columns."""
    if isinstance(pos, Column):
        kept = F.least(F.lit(1.0), F.lit(float(rate)) * pos / (n - pos))
        return F.when(n > pos, kept).otherwise(F.lit(1.0))
    return min(1.0, float(rate) * pos / (n - pos)) if n > pos else 1.0


def downsample_negatives(
    df: DataFrame, rate: float = 20, seed: int = 42, share: float | None = None
) -> DataFrame:
    """All positives and about ``rate`` negatives per positive, chosen by key hash without a shuffle.

    A caller that knows the counts passes ``share``, which saves counting.
    """
    if share is None:
        counts = df.agg(F.sum(F.col("target").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
        keep = counts.select(negative_share(F.col("pos"), F.col("n"), rate)).scalar()
    else:
        keep = F.lit(share)
    kept = hash_bucket(seed, HASH_RANGE, aid="aid") < keep * HASH_RANGE
    return df.where((F.col("target") == 1) | kept)


def downsample_negatives_exact(df: DataFrame, rate: int = 20, seed: int = 42) -> DataFrame:
    """All positives and exactly ``rate`` negatives per positive, or all of them if there are fewer.

    The negatives with the smallest key hashes are kept. The running sum runs over the at most
    ``HASH_RANGE`` hash values, and only the one value at the cut is decided by key order.
    """
    hashed = df.withColumn("h", hash_bucket(seed, HASH_RANGE, aid="aid"))
    negatives = hashed.where(F.col("target") == 0)
    wanted = df.agg(F.sum(F.col("target").cast("long")) * F.lit(rate)).scalar()
    upto = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_hash = negatives.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select("h", "n", F.sum("n").over(upto).alias("upto"))
    at_cut = per_hash.where(F.col("upto") > wanted).orderBy("h").limit(1)
    cut = F.coalesce(at_cut.select("h").scalar(), F.lit(HASH_RANGE))
    left_at_cut = F.coalesce(at_cut.select(wanted - (F.col("upto") - F.col("n"))).scalar(), F.lit(0))
    tied = Window.partitionBy("h").orderBy("session", "aid")
    at_cut_rows = (
        negatives.where(F.col("h") == cut)
        .withColumn("k", F.row_number().over(tied))
        .where(F.col("k") <= left_at_cut)
        .drop("k")
    )
    return hashed.where((F.col("target") == 1) | (F.col("h") < cut)).unionByName(at_cut_rows).drop("h")


def semi_positive_sessions(df: DataFrame) -> DataFrame:
    """Rows of sessions that have at least one positive."""
    positive = df.where(F.col("target") == 1).select("session").distinct()
    return df.join(positive, "session", "left_semi")


def shuffle_within_session(df: DataFrame, seed: int = 42) -> DataFrame:
    """Sessions together, rows of each session in random order."""
    return df.withColumn("_noise", F.rand(seed)).orderBy("session", "_noise").drop("_noise")
