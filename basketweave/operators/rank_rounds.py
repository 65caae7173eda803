"""Rounds of pairwise boosting on session-grouped rows, in which no round moves features.

``SessionRows`` holds one row per session: ids, targets and feature vectors of its candidates as arrays, bucketed by
session. The scores are a narrow table with the same buckets. Pairs, gradients and score updates are worked out inside
the row, so a round joins bucket with bucket and has no exchange of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketweave.functions.events import hash_bucket
from basketweave.operators.sampling import HASH_RANGE
from basketweave.session import drop_bucketed, drop_stage, write_bucketed, write_stage


def tree_sql(tree, vector: str) -> str:
    """A fitted regression tree on numeric features as a nested CASE over the array ``vector``."""

    def node(n) -> str:
        if n.subtreeDepth() == 0:
            return repr(float(n.prediction())) + "D"
        split = n.split()
        return f"CASE WHEN {vector}[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return node(tree._java_obj.rootNode())


def _field(name: str) -> Callable[[Column], Column]:
    return lambda element: element[name]


def _elements(target: int) -> Column:
    """``(aid, score, place)`` of the session's candidates with this target."""
    all_ = F.transform("aids", lambda a, i: F.struct(a.alias("aid"), F.get("scores", i).alias("score"), i.alias("place"), F.get("targets", i).alias("target")))
    return F.transform(F.filter(all_, lambda e: e["target"] == target), lambda e: F.struct(e["aid"], e["score"], e["place"]))


def session_pairs_sampled(grouped: DataFrame, pairs_per_positive: int, seed: int) -> DataFrame:
    """Adds ``pairs``: array of (pos, neg: places in the session; margin), some negatives for each positive.

    The choice is that of ``learn.sample_pairs``: negatives of a session are numbered by the hash of their key, and each
    positive takes the numbers that follow its own hash.
    """
    hashed = lambda aid: hash_bucket(seed, HASH_RANGE, aid=aid)
    in_order = F.array_sort(F.transform(_elements(0), lambda e: F.struct(hashed(e["aid"]).alias("h"), e["aid"], e["score"], e["place"])))
    with_sides = grouped.withColumn("_up", _elements(1)).withColumn("_down", in_order)
    n = F.size("_down")

    def of_positive(e: Column) -> Column:
        taken = F.transform(F.sequence(F.lit(1), F.least(F.lit(pairs_per_positive), n)), lambda j: F.get("_down", F.pmod(hashed(e["aid"]) + j, n).cast("int")))
        return F.transform(taken, lambda d: F.struct(e["place"].alias("pos"), d["place"].alias("neg"), (e["score"] - d["score"]).alias("margin")))

    none = F.array().cast("array<struct<pos:int,neg:int,margin:double>>")
    pairs = F.when(n > 0, F.flatten(F.transform("_up", of_positive))).otherwise(none)
    return with_sides.withColumn("pairs", pairs).drop("_up", "_down")


def gradient_rows(paired: DataFrame) -> DataFrame:
    """``features, label, weight``: two rows for each pair, with the Newton target and the curvature of its loss.

    A candidate in several pairs gives several rows; their weighted mean is its gradient over its curvature.
    """
    miss = lambda p: F.lit(1.0) / (F.lit(1.0) + F.exp(p["margin"]))

    def sides(p: Column) -> Column:
        weight = F.greatest(miss(p) * (1 - miss(p)), F.lit(1e-6))
        return F.array(
            F.struct(F.get("features", p["pos"]).alias("x"), (miss(p) / weight).alias("label"), weight.alias("weight")),
            F.struct(F.get("features", p["neg"]).alias("x"), (-miss(p) / weight).alias("label"), weight.alias("weight")),
        )

    rows = paired.select(F.inline(F.flatten(F.transform("pairs", sides))))
    return rows.select(array_to_vector("x").alias("features"), "label", "weight")


def session_loss() -> tuple[Column, Column]:
    """Sum of the logistic loss over all pairs of a positive and a negative of the session, and the number of pairs."""
    up, down = _elements(1), _elements(0)
    one = lambda p, q: F.log1p(F.exp(q["score"] - p["score"]))
    total = F.aggregate(up, F.lit(0.0), lambda s, p: s + F.aggregate(down, F.lit(0.0), lambda t, q: t + one(p, q)))
    return total, (F.size(up) * F.size(down)).cast("bigint")


class SessionRows:
    """The rows of one ranker: features stored once, scores stored anew in each round."""

    def __init__(self, rows: DataFrame):
        """``rows``: session, aid, target, valid, features (vector)."""
        spark = self.spark = rows.sparkSession
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made: list[tuple[str, str]] = []
        element = F.struct("aid", F.col("target").cast("int").alias("target"), vector_to_array("features").alias("features"))
        grouped = rows.groupBy("session", "valid").agg(F.array_sort(F.collect_list(element), lambda a, b: F.when(a["aid"] < b["aid"], -1).when(a["aid"] > b["aid"], 1).otherwise(0)).alias("e"))
        columns = [F.transform("e", _field(c)).alias(name) for c, name in (("aid", "aids"), ("target", "targets"), ("features", "features"))]
        self.base = self._put(grouped.select("session", "valid", *columns), "rank-rows")
        self.scores = self._put(self.base.select("session", F.transform("aids", lambda a: F.lit(0.0)).alias("scores")), "rank-scores")

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        table, made = write_bucketed(df, f"{name}-{uuid.uuid4().hex}", "session", self.buckets)
        self.made.append(made)
        return table

    def scored(self) -> DataFrame:
        """The rows with their scores: a join of buckets, hashed by the narrow side so that the wide one isn't sorted."""
        return self.base.join(self.scores.hint("shuffle_hash"), "session")

    def move(self, tree, step: float) -> None:
        """Add ``step`` times the tree's prediction to all scores."""
        moved = f"zip_with(scores, features, (s, x) -> s + {float(step)!r}D * ({tree_sql(tree, 'x')}))"
        self.scores = self._put(self.scored().select("session", F.expr(moved).alias("scores")), "rank-scores")
        drop_bucketed(self.spark, self.made.pop(1))

    def training_rows(self, pairs_per_positive: int, seed: int) -> DataFrame:
        return gradient_rows(session_pairs_sampled(self.scored().where(~F.col("valid")), pairs_per_positive, seed))

    def validation_loss(self) -> float | None:
        """Mean loss over all pairs of the validation sessions, or None without pairs; features aren't read."""
        total, n = session_loss()
        sums = self.scored().where("valid").agg(F.sum(total), F.sum(n)).first()
        return sums[0] / sums[1] if sums[1] else None

    def drop(self) -> None:
        for made in self.made:
            drop_bucketed(self.spark, made)
        self.made = []


def fit_rounds(rows: DataFrame, learner, params) -> Sequence:
    """The trees up to the best round on the validation sessions (all rounds without validation pairs)."""
    state = SessionRows(rows)
    trees, best, best_at = [], float("inf"), -1
    for r in range(params.rounds):
        # Written once: growing a tree reads its rows for each level.
        fitted_on, path = write_stage(state.training_rows(params.pairs_per_positive, params.seed + r), "rank-pairs")
        tree = learner.setSeed(params.seed + r).fit(fitted_on).trees[0]
        drop_stage(state.spark, path)
        trees.append(tree)
        state.move(tree, params.stepSize)
        loss = state.validation_loss()
        if loss is None or loss < best:
            best, best_at = best if loss is None else loss, r
        elif r - best_at >= params.early_stopping_rounds:
            break
    state.drop()
    return trees[: best_at + 1]
