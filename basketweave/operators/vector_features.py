"""Features from reduced item vectors ``(aid, svd_0, svd_1, ...)``, over as many dimensions as they have."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketweave.operators.recency import latest_events

LAST = 5
VARIANTS = ("last1", "last5", "all")


def dimensions(vectors: DataFrame, suffix: str = "") -> int:
    """How many columns ``svd_0<suffix>``, ``svd_1<suffix>``, ... there are."""
    n = 0
    while f"svd_{n}{suffix}" in vectors.columns:
        n += 1
    return n


def features_vector_item(vectors: DataFrame) -> DataFrame:
    return vectors.select("aid", *[F.col(f"svd_{i}").alias(f"svd_{i}_candidates") for i in range(dimensions(vectors))])


def features_vector_session(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector of the last item, mean over the last five events and mean over all events of a session.

    Events are first counted per (session, aid), so an item's vector is joined once however often it occurs.
    Means skip events without a vector; the last vector is that of the newest of the last five events that
    has one. A session without any vector gets zeros.

    A vector travels as one column, and one weighted sum per mean adds it up: the plan doesn't grow with the dimensions.
    """
    dims, none = dimensions(vectors), F.lit(None).cast("int")
    tagged = events.select("session", "aid", F.lit(1).alias("n_all"), F.lit(0).alias("n_last"), none.alias("recency"))
    last = latest_events(events, LAST).select(
        "session", "aid", F.lit(0).alias("n_all"), F.lit(1).alias("n_last"), "recency"
    )
    counts = (
        tagged.unionByName(last)
        .groupBy("session", "aid")
        .agg(F.sum("n_all").alias("n_all"), F.sum("n_last").alias("n_last"), F.min("recency").alias("recency"))
    )
    packed = vectors.select(
        "aid", F.array(*[F.coalesce(F.col(f"svd_{i}").cast("double"), F.lit(0.0)) for i in range(dims)]).alias("svd"), F.col("svd_0").isNotNull().alias("known")
    )
    zeros = F.array(*[F.lit(0.0)] * dims)
    joined = counts.join(packed, "aid", "left").select(
        "session", "n_all", "n_last", "recency", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("svd", zeros).alias("svd")
    )
    # Unknown vectors enter the sums as zeros with their full weight: a sum needs some weight in every group.
    rows = joined.withColumn("row", array_to_vector("svd"))
    sums = rows.groupBy("session").agg(
        *[F.sum(F.when(F.col("known"), F.col(n))).alias(f"w_{n}") for n in ("n_all", "n_last")],
        *[Summarizer.sum(F.col("row"), F.col(n).cast("double")).alias(f"sum_{n}") for n in ("n_all", "n_last")],
        F.min_by("svd", F.when(F.col("known"), F.col("recency"))).alias("newest"),
    )
    arrays = sums.select(
        "session", "w_n_all", "w_n_last", "newest", *[vector_to_array(f"sum_{n}").alias(f"sum_{n}") for n in ("n_all", "n_last")]
    )

    def mean(n: str, i: int):
        return F.when(F.col(f"w_{n}") > 0, F.col(f"sum_{n}")[i] / F.col(f"w_{n}")).otherwise(F.lit(0.0))

    return arrays.select(
        "session",
        *[F.coalesce(F.col("newest")[i], F.lit(0.0)).alias(f"svd_{i}_last1") for i in range(dims)],
        *[mean("n_last", i).alias(f"svd_{i}_last{LAST}") for i in range(dims)],
        *[mean("n_all", i).alias(f"svd_{i}_all") for i in range(dims)],
    )


def l1_distance(a: list[str], b: list[str]):
    """Sum of absolute differences of two lists of columns."""
    pairs = [F.abs(F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)]
    return sum(pairs[1:], pairs[0])


def pair_differences(dims: int, variants: tuple[str, ...] = VARIANTS) -> list[Column]:
    """Per variant, candidate minus session vector in each dimension and the L1 total, for rows that hold both; a missing value counts as 0.

    Plain columns: Spark compiles them, while a function over arrays takes each element through an interpreted call.
    """

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    out = []
    for v in variants:
        diffs = [value(f"svd_{i}_candidates") - value(f"svd_{i}_{v}") for i in range(dims)]
        total = sum((F.abs(d) for d in diffs[1:]), F.abs(diffs[0])) if diffs else F.lit(0.0)
        out += [d.alias(f"svd_{i}_diff_candidates_{v}") for i, d in enumerate(diffs)]
        out.append(total.alias(f"svd_total_diff_candidates_{v}"))
    return out


def features_vector_pair(
    candidates: DataFrame,
    item_vectors: DataFrame,
    session_vectors: DataFrame,
    variants: tuple[str, ...] = VARIANTS,
) -> DataFrame:
    """Per variant, the difference between candidate and session vector in each dimension and their L1 total.

    ``item_vectors`` comes from ``features_vector_item`` and ``session_vectors`` from
    ``features_vector_session``. All variants are computed in one pass over the candidates.

    Candidates are dealt over a fixed number of parts: two narrow columns become hundreds of values, so parts that are
    small as keys must not be read by one task (``phases.load_frame`` has both vectors in its rows and needs no such table).
    """
    dims = dimensions(item_vectors, "_candidates")
    parts = 2 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sessions = session_vectors.select("session", *[f"svd_{i}_{v}" for v in variants for i in range(dims)])
    dealt = candidates.select("session", "aid").repartition(parts, "session")
    joined = dealt.join(item_vectors, "aid", "left").join(sessions, "session", "left")
    return joined.select("session", "aid", *pair_differences(dims, variants))
