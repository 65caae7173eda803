"""Training frames, boosted classifiers, the pairwise ranker, scoring and feature importance."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketweave.functions.events import hash_bucket
from basketweave.operators import boost_rounds
from basketweave.operators.rank_rounds import fit_rounds
from basketweave.operators.sampling import (
    HASH_RANGE,
    downsample_negatives,
    group_kfold,
    negative_share,
    semi_positive_sessions,
)
from basketweave.session import drop_stage, ensure_checkpoint_dir, stage, write_stage

KEYS = ("session", "aid")
NOT_FEATURES = (*KEYS, "type", "target", "fold", "candidate_pos")


def feature_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in NOT_FEATURES]


def attach(left: DataFrame, features: DataFrame, keys: Sequence[str], flag: str | None = None, flagged: Sequence[str] = ()) -> DataFrame:
    """Left join on ``keys``; the key of the right side must be unique. Missing features become 0.

    MLlib's trees have no branch for missing values, so a zero alone can't be told from a real one. ``flag`` names a column
    that is 1 where the right side has no row, and each column in ``flagged`` gets a ``<column>_missing`` that is 1
    where its value is missing for any reason; a tree then splits on the flag before the value.
    """
    new = [c for c in features.columns if c not in keys]
    found = "_found"
    while found in left.columns or found in new:
        found += "_"
    if flag:
        features = features.withColumn(found, F.lit(True))
    joined = left.join(features, list(keys), "left")
    flags = [F.col(found).isNull().cast("double").alias(flag)] if flag else []
    flags += [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in new if c in flagged]
    return joined.select(*left.columns, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in new], *flags)


def assemble_features(
    candidates: DataFrame,
    item: Sequence[DataFrame] = (),
    session: Sequence[DataFrame] = (),
    pair: Sequence[DataFrame] = (),
    flags: bool = False,
    flagged: Sequence[str] = (),
) -> DataFrame:
    """All feature tables on the candidates.

    Tables of one key are joined among themselves first. Candidates then pass the item join while they are narrow, the
    pair join, and the session join last: session tables are the widest, and their columns are never shuffled with the
    candidates. With ``flags`` the frame tells rows without item, session or pair features apart (``item_missing`` and so on),
    and the columns in ``flagged`` tell their missing values apart.
    """
    out, added = candidates, {}
    for name, tables, keys in (("item", item, ("aid",)), ("pair", pair, KEYS), ("session", session, ("session",))):
        if not tables:
            continue
        wide = tables[0]
        for t in tables[1:]:
            wide = wide.join(t, list(keys), "full_outer") if keys != KEYS else wide.join(t, list(keys), "left")
        before = len(out.columns)
        out = attach(out, wide, keys, f"{name}_missing" if flags else None, flagged)
        added[name] = out.columns[before:]
    return out.select(*candidates.columns, *[c for name in ("item", "session", "pair") for c in added.get(name, ())])


def assemble_vectors(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(session, aid, target if there is one, features)``."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(frame)
    return assembled.select(*KEYS, *[c for c in ("target",) if c in frame.columns], "features")


def to_vectors(frame: DataFrame, features: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    """``(session, aid, target, fold, features)``, written once because every fold reads it."""
    return stage(group_kfold(assemble_vectors(frame, features), folds, seed), "frame")


@dataclass(frozen=True)
class BoostedParams:
    """The defaults follow the classifier settings being reproduced.

    Boosting goes on until ``early_stopping_rounds`` trees in a row brought no gain on the validation part. The
    number of trees has no bound unless the caller sets ``max_trees``. Without positives in the validation part
    nothing tells when to stop, and ``max_trees`` (or else ``early_stopping_rounds``) trees are grown.
    """

    early_stopping_rounds: int = 100
    max_trees: int | None = None
    stepSize: float = 0.01
    maxDepth: int = 10
    subsamplingRate: float = 0.8
    featureSubsetStrategy: str = "0.2"
    minInstancesPerNode: int = 20
    seed: int = 3655

    def learner(self) -> GBTClassifier:
        own = asdict(self)
        del own["early_stopping_rounds"], own["max_trees"]
        return GBTClassifier(labelCol="label", cacheNodeIds=True, **own)


def boost(train: DataFrame, valid: DataFrame | None, params: BoostedParams) -> GBTClassificationModel:
    """The trees up to the best round on ``valid``, after which ``early_stopping_rounds`` rounds were no better.

    The learner grows tree k alike whatever the number of trees, so the number is doubled until the best round
    lies far enough back; the best beginning is then grown once more. The work is a small multiple of the last fit.
    """
    learner, most = params.learner(), params.max_trees
    if valid is None:
        return learner.setMaxIter(most or params.early_stopping_rounds).fit(train)
    n = 2 * params.early_stopping_rounds
    while True:
        n = n if most is None else min(n, most)
        model = learner.setMaxIter(n).fit(train)
        losses = model.evaluateEachIteration(valid)
        best = min(range(len(losses)), key=losses.__getitem__)
        if len(losses) - 1 - best >= params.early_stopping_rounds or n == most:
            return model if best + 1 == len(losses) else learner.setMaxIter(best + 1).fit(train)
        n *= 2


def tree_learner(params, **more) -> RandomForestRegressor:
    """One regression tree a fit, drawn as ``params`` say."""
    return RandomForestRegressor(
        numTrees=1,
        bootstrap=False,
        maxDepth=params.maxDepth,
        subsamplingRate=params.subsamplingRate,
        featureSubsetStrategy=params.featureSubsetStrategy,
        minInstancesPerNode=params.minInstancesPerNode,
        **more,
    )


def boost_on(train: DataFrame, valid: DataFrame, params: BoostedParams) -> GBTClassificationModel:
    """As ``boost`` without ``max_trees``, but no tree is grown twice: boosting goes on from the trees it has.

    As many trees are grown as are kept, and ``early_stopping_rounds`` more. Rows and features of tree k are drawn by seed + k.
    """
    spark = train.sparkSession
    trees, weights, _ = boost_rounds.fit_rounds(
        train,
        valid,
        tree_learner(params),
        params.stepSize,
        params.early_stopping_rounds,
        params.seed,
        lambda trees, weights: weighted_trees(spark, trees, weights),
    )
    jvm = spark._jvm.org.apache.spark.ml.classification
    uid = f"GBTClassifier_{uuid.uuid4().hex[:12]}"
    return GBTClassificationModel(jvm.GBTClassificationModel(uid, *java_trees(spark, trees, weights), trees[0].numFeatures, 2))


def train_classifier(
    vectors: DataFrame, folds: int = 5, negative_rate: float = 20, params: BoostedParams = BoostedParams()
) -> list[GBTClassificationModel]:
    """One boosted-tree classifier per fold of ``to_vectors``.

    Train and validation parts are down-sampled separately. ``boost_on`` decides on the number of trees, or ``boost`` where
    ``max_trees`` bounds it or nothing is there to validate with.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    counts = fold_counts(vectors)
    models = []
    for k in range(folds):
        parts = []
        for is_valid in (False, True):
            mine = [c for f, c in counts.items() if (f == k) == is_valid]
            pos, n = sum(c[0] for c in mine), sum(c[1] for c in mine)
            share = negative_share(pos, n, negative_rate)
            rows = vectors.where(F.col("fold") == k if is_valid else F.col("fold") != k)
            parts.append((pos, downsample_negatives(rows, share=share)))
        (train_pos, train), (valid_pos, valid) = parts
        if not train_pos:
            raise ValueError(f"no positives outside fold {k}")
        label = F.col("target").cast("double").alias("label")
        train, valid = train.select("features", label), valid.select("features", label) if valid_pos else None
        if params.max_trees or not valid_pos:
            models.append(_boost_written(train, valid, params))
        else:
            models.append(boost_on(train, valid, params))
    return models


def _boost_written(train: DataFrame, valid: DataFrame | None, params: BoostedParams) -> GBTClassificationModel:
    """``boost`` on rows that are written first: each level of each tree reads them, and drawing them hashes every row of the frame."""
    parts = [write_stage(rows, "boost-rows") for rows in (train, valid) if rows is not None]
    try:
        return boost(parts[0][0], parts[1][0] if valid is not None else None, params)
    finally:
        for _, path in parts:
            drop_stage(train.sparkSession, path)


def fold_counts(vectors: DataFrame) -> dict[int, tuple[int, int]]:
    """Positives and rows of each fold."""
    counted = vectors.groupBy("fold").agg(F.sum(F.col("target").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return {r["fold"]: (r["pos"], r["n"]) for r in counted.collect()}


def save_models(models: Sequence, path: str) -> None:
    for k, model in enumerate(models):
        model.write().overwrite().save(f"{path}/fold={k}")


def load_models(path: str, folds: int = 5, model_class=GBTClassificationModel) -> list:
    """Classifiers, or rankers with ``model_class=GBTRegressionModel``."""
    return [model_class.load(f"{path}/fold={k}") for k in range(folds)]


def score_rows(model, vectors: DataFrame, name: str) -> DataFrame:
    """Adds the score of one model as column ``name``: a classifier's probability, a ranker's margin."""
    if isinstance(model, GBTClassificationModel):
        scorer = model.copy().setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        return scorer.transform(vectors).withColumn(name, vector_to_array("_p")[1]).drop("_p")
    return model.copy().setPredictionCol(name).transform(vectors)


def predict_oof(vectors: DataFrame, models: Sequence) -> DataFrame:
    """``(session, aid, score)``: each row scored by the model that did not train on its fold."""
    parts = [
        score_rows(model, vectors.where(F.col("fold") == k), "score").select(*KEYS, "score")
        for k, model in enumerate(models)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def predict_ensemble(vectors: DataFrame, models: Sequence) -> DataFrame:
    """``(session, aid, score)``: mean over all models, one column per model and no shuffle."""
    out = vectors
    for k, model in enumerate(models):
        out = score_rows(model, out, f"score_{k}")
    total = sum((F.col(f"score_{k}") for k in range(len(models))), F.lit(0.0))
    return out.select(*KEYS, (total / len(models)).alias("score"))


def feature_importance(spark: SparkSession, models: Sequence, features: Sequence[str]) -> DataFrame:
    """``(feature, fold, importance)``."""
    rows = [
        (name, k, float(value))
        for k, model in enumerate(models)
        for name, value in zip(features, model.featureImportances.toArray(), strict=True)
    ]
    return spark.createDataFrame(rows, "feature STRING, fold INT, importance DOUBLE")


def mean_importance(importance: DataFrame) -> DataFrame:
    return (
        importance.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")
    )


# --- pairwise ranking --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RankerParams:
    """The defaults follow the ranker settings being reproduced.

    ``pairs_per_positive`` bounds the pairs that a round is fitted on, drawn anew each round. Validation looks at
    all pairs of a session (a session has a bounded number of candidates).
    """

    rounds: int = 1000
    stepSize: float = 0.05
    maxDepth: int = 6
    subsamplingRate: float = 0.8
    featureSubsetStrategy: str = "0.2"
    minInstancesPerNode: int = 20
    early_stopping_rounds: int = 50
    pairs_per_positive: int = 1
    seed: int = 3655


def java_trees(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float]) -> tuple:
    """The trees and their weights as arrays that MLlib's ensemble models are made of."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    of_trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    of_weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        of_trees[i], of_weights[i] = tree._java_obj, float(weight)
    return of_trees, of_weights


def weighted_trees(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float]) -> GBTRegressionModel:
    """One ensemble model whose prediction is the weighted sum of the trees.

    It scores in a single pass however many trees there are, and saves and loads like any model.
    """
    uid = f"BoostedTrees_{uuid.uuid4().hex[:12]}"
    return GBTRegressionModel(spark._jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, *java_trees(spark, trees, weights)))


def tree_sum(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], step: float) -> GBTRegressionModel:
    """One ensemble model whose prediction is ``step`` times the sum of the trees."""
    return weighted_trees(spark, trees, [step] * len(trees))


def sample_pairs(scored: DataFrame, pairs_per_positive: int = 1, seed: int = 42) -> DataFrame:
    """``(session, aid_pos, aid_neg, margin)``: for each positive, some negatives of its session.

    Negatives of a session are numbered in hash order and each positive picks numbers, so the pairs come
    from an equi-join and only the picked ones exist. ``margin`` is the positive's score minus the negative's.
    """
    in_hash_order = Window.partitionBy("session").orderBy(hash_bucket(seed, HASH_RANGE, aid="aid"), "aid")
    negatives = scored.where(F.col("target") == 0).select(
        "session",
        F.col("aid").alias("aid_neg"),
        F.col("score").alias("score_neg"),
        (F.row_number().over(in_hash_order) - 1).cast("long").alias("slot"),
    )
    sizes = negatives.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    positives = (
        scored.where(F.col("target") == 1)
        .join(sizes, "session")
        .select(
            "session",
            F.col("aid").alias("aid_pos"),
            F.col("score").alias("score_pos"),
            "n",
            F.explode(F.sequence(F.lit(1), F.least(F.lit(pairs_per_positive), F.col("n").cast("int")))).alias("j"),
        )
        .withColumn("slot", F.pmod(hash_bucket(seed, HASH_RANGE, aid="aid_pos") + F.col("j"), F.col("n")))
    )
    return positives.join(negatives, ["session", "slot"]).select(
        "session", "aid_pos", "aid_neg", (F.col("score_pos") - F.col("score_neg")).alias("margin")
    )


def all_pairs(scored: DataFrame) -> DataFrame:
    """``(session, margin)`` of every positive with every negative of its session."""
    side = lambda t, name: scored.where(F.col("target") == t).groupBy("session").agg(F.collect_list("score").alias(name))
    met = side(1, "up").join(side(0, "down"), "session")
    met = met.select("session", "down", F.explode("up").alias("up")).select("session", "up", F.explode("down").alias("down"))
    return met.select("session", (F.col("up") - F.col("down")).alias("margin"))


def pair_loss(pairs: DataFrame) -> float | None:
    """Mean logistic loss of the margins, or None without pairs."""
    return pairs.agg(F.avg(F.log1p(F.exp(-F.col("margin"))))).first()[0]


def pair_gradients(pairs: DataFrame) -> DataFrame:
    """``(session, aid, label, weight)``: Newton target and curvature of each row in a pair."""
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("margin")))
    both = pairs.select(
        "session",
        F.inline(
            F.array(
                F.struct(F.col("aid_pos").alias("aid"), miss.alias("g"), (miss * (1 - miss)).alias("h")),
                F.struct(F.col("aid_neg").alias("aid"), (-miss).alias("g"), (miss * (1 - miss)).alias("h")),
            )
        ),
    )
    sums = both.groupBy("session", "aid").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    floor = F.greatest(F.col("h"), F.lit(1e-6))
    return sums.select("session", "aid", (F.col("g") / floor).alias("label"), floor.alias("weight"))


def _fit_ranker(vectors: DataFrame, fold: int, params: RankerParams) -> GBTRegressionModel:
    rows = semi_positive_sessions(vectors).select(*KEYS, "target", (F.col("fold") == fold).alias("valid"), "features")
    if rows.where((F.col("target") == 1) & ~F.col("valid")).isEmpty():
        raise ValueError(f"no positives outside fold {fold}")
    learner = tree_learner(params, weightCol="weight")
    return tree_sum(vectors.sparkSession, fit_rounds(rows, learner, params), params.stepSize)


def train_ranker(
    vectors: DataFrame, folds: int = 5, params: RankerParams = RankerParams()
) -> list[GBTRegressionModel]:
    """One pairwise ranker per fold: boosted regression trees on the gradient of the pairwise logistic loss.

    Only sessions with a positive take part. They are grouped once, one row per session (a session has a bounded number
    of candidates); each round samples negatives for the positives inside the rows, fits one tree to the gradients and
    writes the new scores, so a round exchanges no features and its plan does not grow with the rounds.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    return [_fit_ranker(vectors, k, params) for k in range(folds)]
