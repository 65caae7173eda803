import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from basketweave.functions.events import hash_bucket
from basketweave.operators import learn, rank_rounds, sampling
from basketweave.operators.vectors import item_sequences, reduce_vectors, train_item_vectors
from tests.conftest import rows
from tests.test_covisit import random_log

FEATURES = ["signal", "noise_1", "noise_2"]


@pytest.fixture(scope="module")
def frame(spark):
    """150 sessions of 10 candidates; the target depends on ``signal``."""
    rng = np.random.default_rng(0)
    data = []
    for s in range(150):
        for a in range(10):
            x = rng.normal(size=3)
            data.append((s, a, int(x[0] + 0.3 * rng.normal() > 1.0), *map(float, x)))
    schema = "session BIGINT, aid INT, target INT, " + ", ".join(f"{c} DOUBLE" for c in FEATURES)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def vectors(frame):
    return learn.to_vectors(frame, FEATURES, folds=2)


PARAMS = learn.BoostedParams(max_trees=5, early_stopping_rounds=3, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, featureSubsetStrategy="all")


@pytest.fixture(scope="module")
def models(vectors):
    return learn.train_classifier(vectors, 2, negative_rate=3, params=PARAMS)


def auc(scores, frame):
    joined = scores.join(frame.select("session", "aid", F.col("target").cast("double").alias("label")), ["session", "aid"])
    return BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(joined)


def test_folds_share_no_session(vectors):
    assert vectors.groupBy("session").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert vectors.select("fold").distinct().count() == 2


def test_oof_scores_find_the_signal(vectors, models, frame):
    scores = learn.predict_oof(vectors, models)
    assert scores.count() == frame.count()
    assert scores.where("score < 0 or score > 1").count() == 0
    assert auc(scores, frame) > 0.9


def test_ensemble_is_the_mean_and_models_survive_saving(vectors, models, tmp_path):
    learn.save_models(models, str(tmp_path))
    loaded = learn.load_models(str(tmp_path), 2)
    assert rows(learn.predict_ensemble(vectors, loaded)) == rows(learn.predict_ensemble(vectors, models))
    one = {r[:2]: r[2] for r in rows(learn.score_rows(models[0], vectors, "s"), "session", "aid", "s")}
    two = {r[:2]: r[2] for r in rows(learn.score_rows(models[1], vectors, "s"), "session", "aid", "s")}
    for s, a, score in rows(learn.predict_ensemble(vectors, models)):
        assert math.isclose(score, (one[s, a] + two[s, a]) / 2)


def test_importance_is_led_by_the_signal(spark, models):
    table = learn.feature_importance(spark, models, FEATURES)
    assert table.count() == 6
    assert learn.mean_importance(table).first()["feature"] == "signal"


def test_ranker_finds_the_signal(vectors, frame, tmp_path):
    params = learn.RankerParams(rounds=4, maxDepth=3, stepSize=0.5, minInstancesPerNode=5, featureSubsetStrategy="all")
    rankers = learn.train_ranker(vectors, 2, params)
    scores = learn.predict_oof(vectors, rankers)
    assert auc(scores, frame) > 0.85
    learn.save_models(rankers, str(tmp_path))
    again = learn.load_models(str(tmp_path), 2, GBTRegressionModel)
    assert rows(learn.predict_ensemble(vectors, again)) == rows(learn.predict_ensemble(vectors, rankers))
    assert rankers[0].featureImportances.toArray().argmax() == 0
    assert rankers[0].getNumTrees <= params.rounds


def test_ranker_stops_early(vectors):
    """With random targets the validation loss soon stops falling."""
    noise = vectors.withColumn("target", (F.xxhash64("session", "aid") % 5 == 0).cast("int"))
    params = learn.RankerParams(rounds=12, maxDepth=2, stepSize=1.0, minInstancesPerNode=5, early_stopping_rounds=2)
    model = learn.train_ranker(noise, 1, params)[0]
    assert model.getNumTrees < 12


def test_boosting_waits_for_a_later_gain(vectors):
    """The best round is kept, also where an earlier round was worse than the one before it."""
    noisy = vectors.withColumn("label", F.when(F.xxhash64("session", "aid") % 4 == 0, 1.0 - F.col("target")).otherwise(F.col("target").cast("double")))
    train, valid = (noisy.where(F.col("fold") == k).select("features", "label") for k in (0, 1))
    params = learn.BoostedParams(early_stopping_rounds=12, stepSize=0.6, maxDepth=3, minInstancesPerNode=2, subsamplingRate=0.3, featureSubsetStrategy="all")
    losses = params.learner().setMaxIter(24).fit(train).evaluateEachIteration(valid)
    best = min(range(24), key=losses.__getitem__)
    model = learn.boost(train, valid, params)
    kept = model.evaluateEachIteration(valid)
    assert len(kept) >= best + 1 and kept[: best + 1] == pytest.approx(losses[: best + 1])
    assert kept[-1] == min(kept)
    first_worse = next(i for i in range(1, 24) if losses[i] > losses[i - 1])
    assert first_worse < 23 and (best > first_worse or best + 1 == len(kept))


def test_boosting_reads_written_rows(vectors, monkeypatch):
    """every pass over the rows drew them anew from the whole frame, by a hash of each row."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(learn, "boost", lambda train, valid, params: plans.extend((plan(train), plan(valid))))
    learn.train_classifier(vectors, 2, 1, learn.BoostedParams(max_trees=1))
    assert len(plans) == 4 and not any("md5" in p or "Filter" in p for p in plans)


def test_boosting_goes_on_from_its_trees(vectors, frame, monkeypatch, tmp_path):
    """Trees grown = trees kept + patience, the losses on the way are the model's own, and margins stored anew change nothing."""
    noisy = vectors.withColumn("label", F.when(F.xxhash64("session", "aid") % 4 == 0, 1.0 - F.col("target")).otherwise(F.col("target").cast("double")))
    train, valid = (noisy.where(F.col("fold") == k).select("features", "label") for k in (0, 1))
    params = learn.BoostedParams(early_stopping_rounds=3, stepSize=0.05, maxDepth=3, minInstancesPerNode=20, featureSubsetStrategy="all")
    seen, fit = [], learn.boost_rounds.fit_rounds
    monkeypatch.setattr(learn.boost_rounds, "STORE_EVERY", 2)
    monkeypatch.setattr(learn.boost_rounds, "fit_rounds", lambda *a: seen.append(fit(*a)) or seen[0])
    model = learn.boost_on(train, valid, params)
    trees, weights, losses = seen[0]
    assert len(trees) > 2 and len(losses) == len(trees) + 3 and losses[len(trees) - 1] == min(losses) and weights == model.treeWeights
    assert model.evaluateEachIteration(valid) == pytest.approx(losses[: len(trees)])
    assert model.numFeatures == len(vectors.first()["features"])
    learn.save_models([model], str(tmp_path))
    assert rows(learn.predict_ensemble(vectors, learn.load_models(str(tmp_path), 1))) == rows(learn.predict_ensemble(vectors, [model]))
    assert auc(learn.predict_ensemble(vectors, [model]), frame) > 0.9


def test_pairs_inside_the_rows_are_those_of_the_join(frame):
    scored = frame.withColumn("score", F.col("signal"))
    grouped = scored.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("aid", "target", "score"))).alias("e"))
    grouped = grouped.select("session", *[F.transform("e", rank_rounds._field(c)).alias(n) for c, n in (("aid", "aids"), ("target", "targets"), ("score", "scores"))])
    paired = rank_rounds.session_pairs_sampled(grouped, 3, 7).select("session", "aids", F.inline("pairs"))
    got = paired.select("session", F.get("aids", "pos"), F.get("aids", "neg"), F.round("margin", 9))
    want = learn.sample_pairs(scored, 3, 7).select("session", "aid_pos", "aid_neg", F.round("margin", 9))
    assert rows(got) == rows(want)
    total, n = rank_rounds.session_loss()
    sums = grouped.agg(F.sum(total), F.sum(n)).first()
    assert math.isclose(sums[0] / sums[1], learn.pair_loss(learn.all_pairs(scored)))


def test_trees_as_expressions_predict_alike(vectors):
    rows_ = vectors.select("features", F.col("target").cast("double").alias("label"))
    tree = RandomForestRegressor(numTrees=1, maxDepth=5, seed=1).fit(rows_).trees[0]
    both = tree.transform(vectors).withColumn("x", vector_to_array("features")).withColumn("own", F.expr(rank_rounds.tree_sql(tree, "x")))
    assert both.where("own <> prediction").count() == 0 and both.select("prediction").distinct().count() > 3


def test_a_round_exchanges_no_features(vectors):
    state = rank_rounds.SessionRows(vectors.withColumn("valid", F.col("fold") == 0))
    for df in (state.scored(), state.training_rows(2, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    state.drop()


def test_ranker_orders_sessions_better_than_the_classifier(spark):
    """The chance of a positive rests on the session's level; only the weak feature orders a session."""
    rng = np.random.default_rng(3)
    data = []
    for s in range(300):
        level = rng.normal()
        for a in range(8):
            weak = rng.normal()
            data.append((s, a, int(2.5 * level + 0.8 * weak + 0.3 * rng.normal() > 1.5), float(level), float(weak)))
    frame = spark.createDataFrame(data, "session BIGINT, aid INT, target INT, level DOUBLE, weak DOUBLE")
    vectors = learn.to_vectors(frame, ["level", "weak"], 2)
    shared = dict(maxDepth=1, stepSize=0.3, minInstancesPerNode=5, featureSubsetStrategy="all")
    classifiers = learn.train_classifier(vectors, 2, params=learn.BoostedParams(max_trees=3, **shared))
    rankers = learn.train_ranker(vectors, 2, learn.RankerParams(rounds=3, **shared))

    def ordered(models):
        scored = learn.predict_oof(vectors, models).join(frame, ["session", "aid"]).select("session", "target", "score")
        return learn.all_pairs(scored).agg(F.avg(F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0))).first()[0]

    assert ordered(rankers) > ordered(classifiers) + 0.05
    assert ordered(rankers) > 0.75


def test_missing_values_are_told_from_zeros(spark):
    """The target rests on whether the feature is there; where it is, it is zero half of the time."""
    keys = [(s, a) for s in range(120) for a in range(8)]
    here = {k for k in keys if hash(k) % 3 == 0}
    candidates = spark.createDataFrame([(s, a, int((s, a) in here)) for s, a in keys], "session BIGINT, aid INT, target INT")
    values = spark.createDataFrame([(s, a, float(s % 2), None if a % 2 else 1.0) for s, a in here], "session BIGINT, aid INT, v DOUBLE, w DOUBLE")
    frame = learn.assemble_features(candidates, pair=[values], flags=True, flagged=["w"])
    assert rows(frame.where("pair_missing = 1 and (v <> 0 or w_missing <> 1)")) == []
    assert frame.where("pair_missing = 0 and aid % 2 = 1 and w_missing = 0").count() == 0
    assert rows(learn.attach(candidates, values, ["session", "aid"]), "session", "aid", "v") == rows(frame, "session", "aid", "v")

    def found(names):
        vectors = learn.to_vectors(frame, names, 2)
        params = learn.BoostedParams(max_trees=2, maxDepth=2, minInstancesPerNode=5, featureSubsetStrategy="all")
        return auc(learn.predict_oof(vectors, learn.train_classifier(vectors, 2, params=params)), frame)

    assert found(["v"]) < 0.8 < 0.999 < found(["v", "pair_missing"])


def test_folds_and_samples_are_even_on_strided_ids(spark):
    """Chi-square over buckets, for ids in steps that a linear hash would map to one bucket or a lattice."""
    for step in (1, 5, 7, 1_000_003, 2**20):
        ids = spark.range(0, 20_000).select((F.col("id") * step).alias("session"), F.lit(0).alias("target"), (F.col("id") % 9).alias("aid"))
        counts = [r["count"] for r in sampling.group_kfold(ids).groupBy("fold").count().collect()]
        assert len(counts) == 5 and sum((c - 4000) ** 2 / 4000 for c in counts) < 25
        pairs = ids.select(F.pmod(hash_bucket(42, 1_000_003, aid="aid"), F.lit(64)).alias("b")).groupBy("b").count().collect()
        assert len(pairs) == 64 and sum((r["count"] - 312.5) ** 2 / 312.5 for r in pairs) < 130


def test_all_pairs_of_a_session(spark):
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.1), (1, 0, 0.2), (2, 1, 1.0), (3, 0, 1.0)], "session BIGINT, target INT, score DOUBLE")
    assert [(s, round(m, 6)) for s, m in rows(learn.all_pairs(scored))] == [(1, 0.3), (1, 0.4)]
    assert learn.pair_loss(learn.all_pairs(scored.where("session > 1"))) is None


def test_folds_of_ids_near_the_end_of_the_range(spark):
    ids = [0, 1, 2**63 - 1, -(2**63), 2 * 10**15]
    log = spark.createDataFrame([(s, a, 0) for s in ids for a in ids], "session BIGINT, aid BIGINT, target INT")
    got = {(r[0], r[1]): r[2] for r in rows(sampling.group_kfold(log), "session", "aid", "fold")}
    bucket = lambda s: int(hashlib.md5(f"42:{s}".encode()).hexdigest()[:15], 16) % 5
    assert got == {(s, a): bucket(s) for s in ids for a in ids}
    sampling.downsample_negatives(log, 2, share=0.5).count()
    sampling.downsample_negatives_exact(log.withColumn("target", (F.col("aid") == 1).cast("int")), 1).count()


def test_fold_without_positives(vectors):
    one_sided = vectors.withColumn("target", F.when(F.col("fold") == 0, 0).otherwise(F.col("target")))
    with pytest.raises(ValueError, match="no positives outside fold 1"):
        learn.train_classifier(one_sided, 2, params=PARAMS)
    assert len(learn.train_classifier(one_sided, 1, params=PARAMS)) == 1


def test_pairs_stay_in_the_session_and_are_distinct(frame):
    scored = frame.withColumn("score", F.col("signal"))
    pairs = learn.sample_pairs(scored, pairs_per_positive=3)
    target = {(r["session"], r["aid"]): r["target"] for r in frame.collect()}
    seen = rows(pairs, "session", "aid_pos", "aid_neg")
    assert len(seen) == len(set(seen))
    assert all(target[s, p] == 1 and target[s, n] == 0 for s, p, n in seen)
    negatives = {s: sum(1 for (x, _), t in target.items() if x == s and t == 0) for s, _, _ in seen}
    for key in {(s, p) for s, p, _ in seen}:
        assert sum(1 for x in seen if x[:2] == key) == min(3, negatives[key[0]])


def test_gradients_of_a_pair(spark):
    pairs = spark.createDataFrame([(1, 10, 20, 0.0)], "session BIGINT, aid_pos INT, aid_neg INT, margin DOUBLE")
    assert rows(learn.pair_gradients(pairs)) == [(1, 10, 2.0, 0.25), (1, 20, -2.0, 0.25)]


@pytest.mark.parametrize("rate", [1, 3, 1000])
def test_exact_sample_has_the_exact_size(frame, rate):
    pos, neg = frame.where("target = 1").count(), frame.where("target = 0").count()
    kept = sampling.downsample_negatives_exact(frame, rate)
    assert kept.where("target = 1").count() == pos
    assert kept.where("target = 0").count() == min(neg, rate * pos)
    assert kept.select("session", "aid").distinct().count() == kept.count()


def test_sample_keeps_all_positives_and_about_the_rate(frame):
    pos = frame.where("target = 1").count()
    kept = sampling.downsample_negatives(frame, 2)
    assert kept.where("target = 1").count() == pos
    assert 1.5 * pos < kept.where("target = 0").count() < 2.5 * pos


def test_negative_only_sessions_are_dropped(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "session BIGINT, target INT")
    assert rows(sampling.semi_positive_sessions(df)) == [(1, 0), (1, 1)]


def test_item_vectors_cover_the_catalogue(events):
    log = random_log(9)
    sequences = item_sequences(events(log), max_length=10)
    assert sequences.where(F.size("sentence") > 10).count() == 0
    vectors = train_item_vectors(sequences, size=4, epochs=1, partitions=2)
    assert rows(vectors, "aid") == [(a,) for a in sorted({a for _, a, _, _ in log})]
    assert all(len(v) == 4 and all(map(math.isfinite, v)) for (v,) in rows(vectors, "vector"))


def test_reduction_equals_numpy_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)) + 2.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "aid INT, vector ARRAY<DOUBLE>")
    got = np.array([r[1:] for r in rows(reduce_vectors(df, 3))])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    for j in range(3):
        sign = 1 if vt[j][np.abs(vt[j]).argmax()] > 0 else -1
        np.testing.assert_allclose(got[:, j], sign * u[:, j] * s[j], rtol=1e-6, atol=1e-8)
    gram = got.T @ got
    assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-6)
    assert list(np.diag(gram)) == sorted(np.diag(gram), reverse=True)


def test_session_columns_are_not_shuffled_with_the_candidates(spark, conf):
    """the widest tables were joined first and passed the exchange of the pair join; pair differences were stored and shuffled too."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    from basketweave.plans import phases

    candidates = spark.createDataFrame([(1, 2, 1), (1, 3, 0), (4, 2, 0)], "session BIGINT, aid INT, target INT")
    item = spark.createDataFrame([(2, 0.5)], "aid INT, i DOUBLE")
    session = spark.createDataFrame([(1, 7.0)], "session BIGINT, s DOUBLE")
    pair = spark.createDataFrame([(1, 3, 9.0)], "session BIGINT, aid INT, p DOUBLE")
    frame = learn.assemble_features(candidates, [item], [session], [pair], flags=True)
    assert frame.columns == ["session", "aid", "target", "i", "item_missing", "s", "session_missing", "p", "pair_missing"]
    assert rows(frame) == [(1, 2, 1, 0.5, 0.0, 7.0, 0.0, 0.0, 1.0), (1, 3, 0, 0.0, 1.0, 7.0, 0.0, 9.0, 0.0), (4, 2, 0, 0.5, 0.0, 0.0, 1.0, 0.0, 1.0)]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("[", 1)[1].split("]")[0] for line in plan.splitlines() if "SortMergeJoin" in line]
    assert [k.split("#")[0] for k in keys][0] == "session" and "," not in keys[0]
    assert "vector_pair" not in phases.PAIR
