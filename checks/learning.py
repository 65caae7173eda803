"""Queries for folds, sampling, item vectors, training frames, models and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketweave.functions.events import hash_bucket
from basketweave.operators import features as ft
from basketweave.operators import learn, quality, sampling
from basketweave.operators import recommend as rec
from basketweave.operators import vectors as vect
from basketweave.operators.skipgram import train_skipgram as train_skipgram_vectors
from basketweave.operators.candidates import label_candidates
from basketweave.plans import phases
from basketweave.session import shared_dir, stage
from checks import views as fx
from checks.features import (
    ITEM_COLUMNS,
    MATRIX_COLUMNS,
    PAIR_COLUMNS,
    SESSION_COLUMNS,
    SESSION_VECTOR_COLUMNS,
    _out,
    round_all,
)
from checks.matrices_and_candidates import Inputs, labelled
from checks.registry import query, rounded
from checks.sql import cte, sql
from checks.views import K_EDGES, K_RECALL, N_ADDITIONAL, N_CANDIDATES, T0, T2, VECTOR_DIMS

LIMITS = phases.Limits(
    edges_per_item=K_EDGES, additional=N_ADDITIONAL, candidates=N_CANDIDATES, vector_size=8, vector_dims=4
)
EXACT_LIMITS = phases.Limits(edges_per_item=K_EDGES, additional=N_ADDITIONAL, candidates=N_CANDIDATES)

# --- folds and sampling ------------------------------------------------------------------------------------

def _bucket(buckets, *keys, seed=42):
    text = " || ':' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % {buckets})"


FOLD = f"CAST({_bucket(5, 'session')} AS INTEGER)"
HASH = _bucket(1000003, "session", "aid")
query("group_kfold", sql(f"SELECT session, aid, target, {FOLD} AS fold FROM labelled"))(
    lambda s, d: sampling.group_kfold(labelled(s, d).select("session", "aid", "target"))
)
query(
    "downsample_negatives",
    sql(f"""SELECT session, aid, target FROM labelled, (SELECT sum(target) AS pos, count(*) AS n FROM labelled)
      WHERE target = 1 OR {HASH} < least(1.0, CAST(2.0 AS DOUBLE) * pos / (n - pos)) * 1000003"""),
)(lambda s, d: sampling.downsample_negatives(labelled(s, d).select("session", "aid", "target"), 2))
query(
    "downsample_negatives_exact",
    sql(f"""SELECT session, aid, target FROM (SELECT session, aid, target,
        row_number() OVER (PARTITION BY target ORDER BY {HASH}, session, aid) AS k, sum(target) OVER () AS pos FROM labelled)
      WHERE target = 1 OR k <= 2 * pos"""),
)(
    lambda s, d: sampling.downsample_negatives_exact(
        stage(labelled(s, d).select("session", "aid", "target"), "labelled"), 2
    )
)
query(
    "semi_positive_sessions",
    sql("SELECT session, aid, target FROM labelled WHERE session IN (SELECT session FROM labelled WHERE target = 1)"),
)(lambda s, d: sampling.semi_positive_sessions(labelled(s, d).select("session", "aid", "target")))
query("shuffle_within_session", sql("SELECT session, aid, target FROM labelled"))(
    lambda s, d: sampling.shuffle_within_session(labelled(s, d).select("session", "aid", "target"))
)


@query(
    "sample_pairs",
    sql(f"""SELECT p.session, p.aid AS aid_pos, n.aid AS aid_neg FROM
        (SELECT session, aid, ({HASH} + 1) AS h FROM labelled WHERE target = 1) p
        JOIN (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY {HASH}, aid) - 1 AS slot,
            count(*) OVER (PARTITION BY session) AS n FROM labelled WHERE target = 0) n
        ON p.session = n.session AND n.slot = p.h % n.n"""),
)
def sample_pairs(spark, sf):
    scored = labelled(spark, sf).select("session", "aid", "target", F.lit(0.0).alias("score"))
    return learn.sample_pairs(scored).drop("margin")


# --- vectors -----------------------------------------------------------------------------------------------

query(
    "item_sequences",
    sql("SELECT session, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY ts, event_id) AS sentence FROM fx_known GROUP BY session"),
)(
    lambda s, d: vect.item_sequences(fx.fx_known(s, d)).select(
        "session", F.array_join("sentence", " ").alias("sentence")
    )
)
# The same cut into chunks of seven items.
query(
    "item_sequences_chunked",
    sql("""SELECT session, CAST((k - 1) // 7 AS BIGINT) AS chunk, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY k) AS sentence
      FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM fx_known)
      GROUP BY session, (k - 1) // 7"""),
)(
    lambda s, d: vect.item_sequences(fx.fx_known(s, d), max_length=7).select(
        "session", "chunk", F.array_join("sentence", " ").alias("sentence")
    )
)


# What SQL can know of trained vectors: an item each, all dimensions, finite.
@query("train_item_vectors", sql("SELECT DISTINCT aid, 50 AS dimensions, true AS finite FROM fx_known"))
def train_item_vectors(spark, sf):
    sequences = stage(vect.item_sequences(fx.fx_known(spark, sf)), "sequences")
    flat = vect.flatten_vectors(vect.train_item_vectors(sequences, partitions=4))
    total = sum((F.col(c) for c in flat.columns[1:]), F.lit(0.0))
    finite = total.isNotNull() & ~F.isnan(total) & (F.abs(total) < 1e300)
    return flat.select("aid", F.lit(len(flat.columns) - 1).alias("dimensions"), finite.alias("finite"))


CLUSTERS = 4


# A planted answer: sessions of one class hold that class's items alone, so items lie nearest to their own class's mean.
@query("train_skipgram", sql(f"SELECT DISTINCT session % {CLUSTERS} AS class, true AS found FROM fx_known"))
def train_skipgram(spark, sf):
    owner = F.col("session") % CLUSTERS
    planted = fx.fx_known(spark, sf).withColumn("aid", (owner * 1000 + F.col("aid") % 20).cast("long"))
    trained = stage(train_skipgram_vectors(planted, size=8, rate=0.2, sample=0, block_items=30), "skipgram")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    unit = trained.select((F.col("aid") / 1000).cast("long").alias("class"), F.transform("vector", lambda x: x / norm).alias("vector"))
    means = unit.groupBy("class").agg(*[F.avg(F.col("vector")[k]).alias(f"m{k}") for k in range(8)]).orderBy("class").collect()
    close = F.array(*[sum(F.col("vector")[k] * F.lit(row[f"m{k}"]) for k in range(8)) for row in means])
    nearest = F.array(*[F.lit(row["class"]) for row in means])[(F.array_position(close, F.array_max(close)) - 1).cast("int")]
    return unit.groupBy("class").agg((F.avg((nearest == F.col("class")).cast("double")) >= 0.9).alias("found"))


# The reduction is a projection: no vector gets longer, the columns are orthogonal and fall in length.
@query("reduce_vectors", sql("SELECT vec_id AS aid, true AS no_longer, true AS orthogonal, true AS descending FROM embeddings"))
def reduce_vectors(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("aid"), F.col("embedding").cast("array<double>").alias("vector")
    )
    flat = stage(vect.reduce_vectors(vectors).join(vectors, "aid"), "reduced")
    names = [f"svd_{i}" for i in range(10)]
    products = flat.agg(*[F.abs(F.sum(F.col(a) * F.col(b))).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[:i]])
    squares = flat.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in names])
    falls = [F.col(a) >= F.col(b) for a, b in zip(names, names[1:])]
    length = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))
    whole = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return flat.select(
        "aid",
        (length <= whole + 1e-6).alias("no_longer"),
        products.select(F.greatest(*products.columns) < 1e-6).scalar().alias("orthogonal"),
        squares.select(F.forall(F.array(*falls), lambda x: x)).scalar().alias("descending"),
    )


# --- training frame ----------------------------------------------------------------------------------------

VECTOR_PAIR_COLUMNS = {
    v: [f"svd_{i}_diff_candidates_{v}" for i in range(VECTOR_DIMS)] + [f"svd_total_diff_candidates_{v}"]
    for v in ("last1", "last5", "all")
}
MATRIX_LAST = [f"cvm_weight_{k}_last1" for k in ("buys", "buy2buy", "clicks")]
VECTOR_ITEM = [f"svd_{i}_candidates" for i in range(VECTOR_DIMS)]
cte("vector_item", "SELECT aid, " + ", ".join(f"svd_{i} AS svd_{i}_candidates" for i in range(VECTOR_DIMS)) + " FROM fx_item_vectors")
cte("pair_feats", f"SELECT session, aid, candidates_rank, {', '.join(_out)} FROM pair_base")
FRAME_COLUMNS = [
    *ITEM_COLUMNS, *SESSION_COLUMNS, *PAIR_COLUMNS, *MATRIX_COLUMNS["all"], *MATRIX_COLUMNS["5"], *MATRIX_LAST,
    *VECTOR_ITEM, *SESSION_VECTOR_COLUMNS, *[c for v in VECTOR_PAIR_COLUMNS.values() for c in v],
]
_on = "ON {t}.session = l.session AND {t}.aid = l.aid"
FRAME_SQL = (
    "SELECT l.session, l.aid, l.type, l.target, "
    + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in FRAME_COLUMNS)
    + " FROM labelled l LEFT JOIN item_feats i ON i.aid = l.aid LEFT JOIN vector_item vi ON vi.aid = l.aid"
    + " LEFT JOIN session_feats s ON s.session = l.session LEFT JOIN session_vectors sv ON sv.session = l.session "
    + " ".join(
        f"LEFT JOIN {t} {_on.format(t=t)}"
        for t in ("pair_feats", "matrix_feats", "matrix_last", "vector_pair_last1", "vector_pair_last5", "vector_pair_all")
    )
)


def built_root(spark, sf, limits, vectors):
    """All tables of the train phase, written under a new folder."""
    root = f"{shared_dir(spark)}/phase-{uuid.uuid4().hex}"
    phases.build_phase(
        fx.fx_known(spark, sf), fx.fx_observed(spark, sf), root, "train", T0, T2, limits, vectors
    )
    return root


@query("assemble_features", sql(FRAME_SQL))
def assemble_features(spark, sf):
    root = built_root(spark, sf, EXACT_LIMITS, fx.fx_item_vectors(spark, sf))
    frame = phases.load_frame(spark, root, "train", 2, fx.fx_labels(spark, sf))
    return round_all(frame, ("session", "aid", "type", "target"))


# --- models: a small frame of item, pair and rank features --------------------------------------------------

SMALL = learn.BoostedParams(max_trees=5, early_stopping_rounds=2, maxDepth=4, stepSize=0.1, minInstancesPerNode=5, featureSubsetStrategy="0.5")
SMALL_RANK = learn.RankerParams(rounds=3, maxDepth=4, minInstancesPerNode=5, featureSubsetStrategy="0.5", stepSize=0.1)


def small_frame(made):
    pairs, seen = made.candidates("buys"), made.observed
    return learn.assemble_features(
        label_candidates(pairs.select("session", "aid"), 2, made.labels),
        item=[ft.features_item(made.known, seen)],
        session=[ft.features_session(seen)],
        pair=[ft.features_session_item(pairs, seen)],
    )


def small_vectors(spark, sf, folds):
    frame = small_frame(Inputs(spark, sf))
    names = learn.feature_columns(frame)
    return learn.to_vectors(frame, names, folds), names


FEATURES_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in [*ITEM_COLUMNS, *SESSION_COLUMNS, *PAIR_COLUMNS]) + ") f(feature)"


@query("train_classifier", sql(f"SELECT feature, CAST(fold AS INTEGER) AS fold, true AS valid, true AS whole FROM {FEATURES_SQL}, range(2) t(fold)"))
def train_classifier(spark, sf):
    vectors, names = small_vectors(spark, sf, 2)
    models = learn.train_classifier(vectors, 2, params=SMALL)
    importance = learn.feature_importance(spark, models, names)
    total = F.sum("importance").over(Window.partitionBy("fold"))
    return importance.select("feature", "fold", (F.col("importance") >= 0).alias("valid"), (F.abs(total - 1) < 1e-6).alias("whole"))


@query("feature_importance", sql(f"SELECT feature, true AS valid FROM {FEATURES_SQL}"))
def feature_importance(spark, sf):
    vectors, names = small_vectors(spark, sf, 2)
    models = learn.train_classifier(vectors, 2, params=SMALL)
    mean = learn.mean_importance(learn.feature_importance(spark, models, names))
    return mean.select("feature", F.col("importance").between(0, 1).alias("valid"))


@query("mean_importance", sql(f"SELECT feature, true AS mean FROM {FEATURES_SQL}"))
def mean_importance(spark, sf):
    """Against the importances of two models, averaged by hand."""
    vectors, names = small_vectors(spark, sf, 2)
    models = learn.train_classifier(vectors, 2, params=SMALL)
    one, two = (m.featureImportances.toArray() for m in models)
    by_hand = spark.createDataFrame([(n, float(a + b) / 2) for n, a, b in zip(names, one, two)], "feature STRING, value DOUBLE")
    mean = learn.mean_importance(learn.feature_importance(spark, models, names))
    return mean.join(by_hand, "feature").select("feature", (F.abs(F.col("importance") - F.col("value")) < 1e-9).alias("mean"))


FOLD_OF_TWO = f"CAST({_bucket(2, 'session')} AS INTEGER)"


@query("predict_oof", sql(f"SELECT session, aid, {FOLD_OF_TWO} AS fold, true AS is_probability, true AS by_other_fold FROM labelled"))
def predict_oof(spark, sf):
    vectors, _ = small_vectors(spark, sf, 2)
    models = learn.train_classifier(vectors, 2, params=SMALL)
    both = learn.score_rows(models[1], learn.score_rows(models[0], vectors, "s0"), "s1").select("session", "aid", "fold", "s0", "s1")
    own = F.when(F.col("fold") == 0, F.col("s0")).otherwise(F.col("s1"))
    return learn.predict_oof(vectors, models).join(both, ["session", "aid"]).select(
        "session", "aid", "fold", F.col("score").between(0, 1).alias("is_probability"), (F.abs(F.col("score") - own) < 1e-9).alias("by_other_fold")
    )


@query("predict_ensemble", sql("SELECT session, aid, true AS is_mean FROM labelled"))
def predict_ensemble(spark, sf):
    vectors, _ = small_vectors(spark, sf, 2)
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    models = learn.train_classifier(vectors, 2, params=SMALL)
    learn.save_models(models, path)
    both = learn.score_rows(models[1], learn.score_rows(models[0], vectors, "s0"), "s1").select("session", "aid", "s0", "s1")
    scores = learn.predict_ensemble(vectors, learn.load_models(path, 2))
    mean = (F.col("s0") + F.col("s1")) / 2
    return scores.join(both, ["session", "aid"]).select("session", "aid", (F.abs(F.col("score") - mean) < 1e-9).alias("is_mean"))


@query("train_ranker", sql("SELECT session, aid, true AS finite FROM labelled"))
def train_ranker(spark, sf):
    vectors, _ = small_vectors(spark, sf, 2)
    scores = learn.predict_oof(vectors, learn.train_ranker(vectors, 2, SMALL_RANK))
    return scores.select("session", "aid", (F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < 1e300)).alias("finite"))


# Planted targets, so that the answer is known: a constant model turns these rows red.
PLANTED = _bucket(10, "session", "aid", seed=7)


def planted_vectors(spark, sf, from_):
    """Candidates with a feature of ten values, on which alone the target rests, and one of noise."""
    value = hash_bucket(7, 10, aid="aid").cast("double")
    noise = hash_bucket(8, 1000, aid="aid").cast("double")
    rows = labelled(spark, sf).select("session", "aid", (value >= from_).cast("int").alias("target"), value.alias("value"), noise.alias("noise"))
    return learn.to_vectors(rows, ["value", "noise"], 2)


PLAIN = dict(maxDepth=3, minInstancesPerNode=5, featureSubsetStrategy="all", stepSize=0.3)


@query("train_classifier_planted", sql(f"SELECT session, aid, CAST({PLANTED} >= 7 AS INTEGER) AS predicted FROM labelled"))
def train_classifier_planted(spark, sf):
    vectors = planted_vectors(spark, sf, 7)
    scores = learn.predict_oof(vectors, learn.train_classifier(vectors, 2, params=learn.BoostedParams(max_trees=3, early_stopping_rounds=2, **PLAIN)))
    return scores.select("session", "aid", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("train_classifier_patience", sql(f"SELECT session, aid, CAST({PLANTED} >= 7 AS INTEGER) AS predicted FROM labelled"))
def train_classifier_patience(spark, sf):
    """With no bound on the trees. One label in eight is turned, so that patience ends it; leaves hold too many rows to follow single labels."""
    vectors = planted_vectors(spark, sf, 7)
    turned = F.when(hash_bucket(9, 8, session="session", aid="aid") == 0, 1 - F.col("target")).otherwise(F.col("target"))
    params = learn.BoostedParams(early_stopping_rounds=2, **PLAIN | {"minInstancesPerNode": 100})
    scores = learn.predict_oof(vectors, learn.train_classifier(vectors.withColumn("target", turned), 2, params=params))
    return scores.select("session", "aid", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "train_ranker_planted",
    sql(f"""SELECT session, min(v) FILTER (WHERE v >= 7) AS least_positive, max(v) FILTER (WHERE v < 7) AS most_negative, true AS ordered
      FROM (SELECT session, {PLANTED} AS v FROM labelled) GROUP BY session
      HAVING count(*) FILTER (WHERE v >= 7) > 0 AND count(*) FILTER (WHERE v < 7) > 0"""),
)
def train_ranker_planted(spark, sf):
    vectors = planted_vectors(spark, sf, 7)
    scores = learn.predict_oof(vectors, learn.train_ranker(vectors, 2, learn.RankerParams(rounds=3, **PLAIN)))
    value, up = hash_bucket(7, 10, aid="aid"), hash_bucket(7, 10, aid="aid") >= 7
    best = scores.groupBy("session").agg(
        F.min(F.when(up, value)).alias("least_positive"),
        F.max(F.when(~up, value)).alias("most_negative"),
        (F.min(F.when(up, F.col("score"))) > F.max(F.when(~up, F.col("score")))).alias("ordered"),
    )
    return best.where(F.col("least_positive").isNotNull() & F.col("most_negative").isNotNull())


@query(
    "feature_attach_flags",
    sql("""SELECT l.session, l.aid, coalesce(p.n, 0) AS n, CAST(p.n IS NULL AS INTEGER) AS pair_missing
      FROM labelled l LEFT JOIN (SELECT session, aid, CAST(count(*) AS DOUBLE) AS n FROM fx_observed GROUP BY session, aid) p
      ON p.session = l.session AND p.aid = l.aid"""),
)
def feature_attach_flags(spark, sf):
    counts = fx.fx_observed(spark, sf).groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n"))
    frame = learn.assemble_features(labelled(spark, sf).select("session", "aid"), pair=[counts], flags=True)
    return frame.withColumn("pair_missing", F.col("pair_missing").cast("int"))


@query(
    "recall_of_oof_scores",
    sql(f"SELECT sum(least(len(ground_truth), {K_RECALL})) AS gt_count, true AS hits_fit FROM fx_labels WHERE type = 'orders'"),
)
def recall_of_oof_scores(spark, sf):
    vectors, _ = small_vectors(spark, sf, 2)
    scores = learn.predict_oof(vectors, learn.train_classifier(vectors, 2, params=SMALL))
    found = rec.recall_at(rec.make_recommendations(scores, 2), fx.fx_labels(spark, sf), 2, K_RECALL)
    return found.select("gt_count", F.col("hits").between(0, F.col("gt_count")).alias("hits_fit"))


# --- data quality ------------------------------------------------------------------------------------------

def _narrow(c):
    """The smallest type whose open range holds the column, in SQL."""
    fits = " ".join(f"WHEN min({c}) OVER () > -{top} AND max({c}) OVER () < {top} - 1 THEN '{name}'" for name, top in (("tinyint", 128), ("smallint", 32768), ("int", 2147483648)))
    return f"CASE {fits} ELSE 'bigint' END"


query(
    "narrow_types",
    sql("SELECT session, aid, ts, type, " + ", ".join(f"{_narrow(c)} AS {c}_type" for c in ("session", "aid", "ts", "type")) + " FROM fx_events"),
)(lambda s, d: _with_types(quality.narrow_types(fx.fx_events(s, d).select("session", "aid", "ts", "type"))))


def _with_types(df):
    return df.select("*", *[F.typeof(c).alias(f"{c}_type") for c in df.columns])

query(
    "quality_report",
    sql("""SELECT 'session_score' AS "column", count(*) FILTER (WHERE session_score IS NULL) AS nulls, 0 AS infinite FROM cand_buys
      UNION ALL SELECT 'wgt', count(*) FILTER (WHERE wgt IS NULL), 0 FROM cand_buys
      UNION ALL SELECT 'aid', 0, 0"""),
)(lambda s, d: quality.quality_report(Inputs(s, d).merged("buys").select("session_score", "wgt", "aid")))
