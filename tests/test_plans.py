"""A phase, three models and the submission, end to end."""

import os

import pytest

from basketweave.operators import learn
from basketweave.plans import models, phases
from basketweave.session import stage
from basketweave.sources import tables
from checks import views as fx
from checks.matrices_and_candidates import Inputs

DATA = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")
LIMITS = phases.Limits(edges_per_item=10, additional=24, candidates=20, vector_size=12, vector_dims=10)
PARAMS = learn.BoostedParams(max_trees=1, early_stopping_rounds=1, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, featureSubsetStrategy="all")


def test_whole_run(spark, tmp_path):
    root = str(tmp_path)
    known, seen, labels = fx.fx_known(spark, DATA), fx.fx_observed(spark, DATA), fx.fx_labels(spark, DATA)
    phases.build_phase(known, seen, root, "train", fx.T0, fx.T2, LIMITS)
    vectors = tables.load_item_vectors(spark, root, "train")
    assert vectors.count() == known.select("aid").distinct().count()
    assert tables.load_item_vectors(spark, root, "train").columns == ["aid", *[f"svd_{i}" for i in range(10)]]
    # The same log stands in for the test phase, with its scaled matrix features.
    phases.build_phase(known, seen, root, "test", fx.T0, fx.T2, LIMITS, vectors=stage(vectors, "vectors"))
    scaled, plain = (spark.read.parquet(f"{root}/features/phase={p}/table=matrix").select("session", "aid", "wgt_buys_sum_lastall") for p in ("test", "train"))
    both = scaled.join(plain.withColumnRenamed("wgt_buys_sum_lastall", "whole"), ["session", "aid"])
    assert both.where("abs(wgt_buys_sum_lastall - whole * 7 / 9) > 1e-6").count() == 0
    assert spark.read.csv(f"{root}/reports/candidates-train-buys", header=True).count() == 1

    frame = phases.load_frame(spark, root, "train", 2, labels)
    assert len(learn.feature_columns(frame)) == 223
    assert frame.count() == tables.load_candidates(spark, root, "train", 2).count()

    for type_id in (0, 1, 2):
        recall = models.train_and_evaluate(spark, root, type_id, labels, folds=2, params=PARAMS, recall_k=5).first()
        assert 0 < recall["hits"] <= recall["gt_count"]
        models.predict(spark, root, type_id, folds=2)
    score = models.local_score(spark, root, labels, recall_k=5).first()
    assert 0 < score["score"] <= 1 and score["recall_orders"] > 0
    sessions = seen.select("session").distinct().count()
    assert models.make_submission(spark, root) == {"rows": 3 * sessions}
    combined = tables.load_submission(spark, f"{root}/submissions/combined")
    assert combined.where("session_type LIKE '%_orders'").count() == sessions
    assert os.path.isdir(f"{root}/models/orders-classifier/importance")


@pytest.mark.parametrize("dims", [4, 16])
def test_vector_dimensions_reach_every_table(spark, dims):
    from basketweave.operators import vector_features as vec

    seen = fx.fx_observed(spark, DATA)
    vectors = fx.fx_item_vectors(spark, DATA).select("aid", *[f"svd_{i}" for i in range(dims)])
    item, session = vec.features_vector_item(vectors), vec.features_vector_session(seen, vectors)
    pair = vec.features_vector_pair(seen.select("session", "aid").distinct(), item, session)
    assert (len(item.columns), len(session.columns), len(pair.columns)) == (1 + dims, 1 + 3 * dims, 2 + 3 * (dims + 1))
    assert pair.count() == seen.select("session", "aid").distinct().count()


def test_a_bad_table_does_not_replace_a_good_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.save_parquet(spark.range(5), path, checked=True)
    with pytest.raises(ValueError, match="null"):
        tables.save_parquet(spark.range(3).selectExpr("nullif(id, 1) AS id"), path, checked=True)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    tables.save_parquet(spark.range(7), path, checked=True)
    assert spark.read.parquet(path).count() == 7


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError, match="phase"):
        tables.load_covisit(spark, "x", "dev", "buys")
    with pytest.raises(ValueError, match="type_id"):
        tables.load_candidates(spark, "x", "train", 3)
    with pytest.raises(ValueError, match="learner"):
        models.train_and_evaluate(spark, "x", 0, None, learner="forest")


def test_log_without_event_id_gets_a_stable_tie_break(spark, tmp_path):
    rows = [(1, 10, 5, 0), (1, 11, 5, 0), (1, 12, 5, 0)]
    for name, part in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(part, "session BIGINT, aid INT, ts BIGINT, type INT").write.parquet(f"{tmp_path}/{name}")
    a, b = (tables.load_events(spark, f"{tmp_path}/{n}") for n in "ab")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bad_features_are_caught_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "aid INT, x DOUBLE")
    with pytest.raises(ValueError, match="x"):
        tables.save_parquet(df, f"{tmp_path}/t", checked=True)
    assert tables.save_parquet(df.fillna(0), f"{tmp_path}/u", checked=True) == {"rows": 2}


def test_queries_read_the_raw_events_once(spark):
    """each view of the log parsed the raw table anew, and both kinds of edges made all pairs."""
    made = Inputs(spark, DATA)
    for df in (made.log, *made.recommended_and_labels(), made.known, made.positioned()):
        assert "events.parquet" not in str(df.inputFiles())
    assert {"log", "positions", "day-weights"} <= set(made.made)
