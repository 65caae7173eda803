"""Train, evaluate and predict per type, and the combined submission, on the tables of ``phases``."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession

from basketweave.functions.events import TYPE_IDS, TYPE_NAMES
from basketweave.operators import learn
from basketweave.operators import recommend as rec
from basketweave.plans.phases import load_frame
from basketweave.session import stage
from basketweave.sources.tables import load_submission, save_csv, save_parquet

CLASSIFIER, RANKER = "classifier", "ranker"
_MODEL_CLASS = {CLASSIFIER: GBTClassificationModel, RANKER: GBTRegressionModel}


def _model_path(root: str, type_id: int, learner: str) -> str:
    return f"{root}/models/{TYPE_NAMES[type_id]}-{learner}"


def train_and_evaluate(
    spark: SparkSession,
    root: str,
    type_id: int,
    labels: DataFrame,
    learner: str = CLASSIFIER,
    folds: int = 5,
    params: learn.BoostedParams | learn.RankerParams | None = None,
    recall_k: int = 20,
) -> DataFrame:
    """Train one model per fold, save models, importance and out-of-fold lists; returns the recall row."""
    if learner not in _MODEL_CLASS:
        raise ValueError(f"learner must be one of {list(_MODEL_CLASS)}, got {learner!r}")
    frame = load_frame(spark, root, "train", type_id, labels)
    names = learn.feature_columns(frame)
    vectors = learn.to_vectors(frame, names, folds)
    if learner == CLASSIFIER:
        models = learn.train_classifier(vectors, folds, params=params or learn.BoostedParams())
    else:
        models = learn.train_ranker(vectors, folds, params or learn.RankerParams())
    path = _model_path(root, type_id, learner)
    learn.save_models(models, path)
    importance = stage(learn.feature_importance(spark, models, names), "importance")
    save_csv(importance, f"{path}/importance")
    save_csv(learn.mean_importance(importance), f"{path}/mean_importance")
    lists = stage(rec.make_recommendations(learn.predict_oof(vectors, models), type_id), "oof")
    save_csv(lists, f"{root}/oof/{TYPE_NAMES[type_id]}-{learner}")
    return rec.recall_at(lists, labels, type_id, recall_k)


def local_score(spark: SparkSession, root: str, labels: DataFrame, learner: str = CLASSIFIER, recall_k: int = 20) -> DataFrame:
    """Recall of each type and their weighted sum, from the saved out-of-fold lists of all types."""
    lists = load_submission(spark, *[f"{root}/oof/{name}-{learner}" for name in TYPE_IDS])
    return rec.weighted_score(lists, labels, recall_k)


def predict(spark: SparkSession, root: str, type_id: int, learner: str = CLASSIFIER, folds: int = 5) -> dict:
    """Score the test-phase candidates with the mean of the saved models and write the lists as CSV."""
    frame = load_frame(spark, root, "test", type_id)
    vectors = learn.assemble_vectors(frame, learn.feature_columns(frame))  # read once, so not written
    models = learn.load_models(_model_path(root, type_id, learner), folds, _MODEL_CLASS[learner])
    scores = learn.predict_ensemble(vectors, models)
    save_parquet(scores, f"{root}/scores/{TYPE_NAMES[type_id]}")
    stored = spark.read.parquet(f"{root}/scores/{TYPE_NAMES[type_id]}")
    return save_csv(rec.make_recommendations(stored, type_id), f"{root}/submissions/{TYPE_NAMES[type_id]}")


def make_submission(spark: SparkSession, root: str) -> dict:
    """One sorted CSV of all three types."""
    parts = [load_submission(spark, f"{root}/submissions/{name}") for name in TYPE_IDS]
    return save_csv(rec.concat_submissions(*parts), f"{root}/submissions/combined")
