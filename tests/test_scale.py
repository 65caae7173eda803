"""Plans and results when one session or one item holds a large part of the log."""

import re

import pytest
from pyspark.sql import functions as F

from basketweave.operators import candidates as cand
from basketweave.operators import covisit as cv
from basketweave.operators import features as ft
from basketweave.operators import matrix_features as mx
from basketweave.operators import vector_features as vec
from basketweave.operators.learn import attach
from basketweave.operators.recency import latest_events, ranked_runs, with_positions
from basketweave.session import build_session, drop_stage, shared_dir, stage, write_stage
from tests.conftest import rows


def plan(df) -> str:
    """The executed plan; adaptive plans are final after a run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def initial_plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def log(spark):
    """A third of 90,000 events belong to session 0 and a third to item 0."""
    i = F.col("id")
    return spark.range(90_000).select(
        F.when(i % 3 == 0, 0).otherwise(i % 4001).cast("long").alias("session"),
        F.when(i % 3 == 1, 0).otherwise(i % 997).cast("int").alias("aid"),
        (i * 31 % 1_000_000).alias("ts"),
        F.when(i % 7 == 0, 1).when(i % 11 == 0, 2).otherwise(0).alias("type"),
        i.alias("event_id"),
    )


@pytest.fixture(scope="module")
def links(spark):
    x = F.col("id")
    return spark.range(997 * 10).select(
        (x % 997).cast("int").alias("aid_x"), ((x * 17 + 5) % 997).cast("int").alias("aid_y"), (x % 50 + 1).alias("wgt")
    ).where("aid_x <> aid_y").dropDuplicates(["aid_x", "aid_y"])


def operators(log, links):
    cands = log.select("session", "aid").distinct().withColumn("candidate_pos", F.lit(0))
    kinds = {k: links for k in mx.KINDS}
    return {
        "buy2buy": cv.covisit_buy2buy(log),
        "type_weighted": cv.covisit_type_weighted(log),
        "time_weighted": cv.covisit_time_weighted(log, 0, 1_000_000),
        "score_buys": cand.session_score_buys(log, links),
        "score_clicks": cand.session_score_clicks(log),
        "additional_clicks": cand.additional_clicks(log, links, 20),
        "additional_buys": cand.additional_buys(log, links, links, 20),
        "features_session": ft.features_session(log),
        "features_session_item": ft.features_session_item(cands, log),
        "features_matrix": mx.features_matrix(cands, log, kinds),
        "features_matrix_last": mx.features_matrix_last(cands, log, kinds),
    }


@pytest.mark.parametrize(
    "name",
    ["buy2buy", "type_weighted", "time_weighted", "score_buys", "score_clicks", "additional_clicks", "additional_buys",
     "features_session", "features_session_item", "features_matrix", "features_matrix_last"],
)
def test_no_python_no_cross_join_no_single_partition(log, links, name):
    text = initial_plan(operators(log, links)[name])
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|PythonMapIn|FlatMapGroupsIn", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    physical = text[text.index("== Physical Plan =="):]
    # Only the bounded list of top items and of marked sessions may meet in one partition.
    single = [line for line in physical.splitlines() if "SinglePartition" in line]
    assert not single or name.startswith("additional"), single


@pytest.mark.parametrize("n", [1, 30])
def test_newest_rows_are_cut_before_the_shuffle(log, n):
    text = initial_plan(latest_events(log, n))
    physical = text[text.index("== Physical Plan =="):]
    lines = physical.splitlines()
    partial = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
    exchange = next(i for i, x in enumerate(lines) if "Exchange" in x)
    assert exchange < partial  # plans read bottom up


@pytest.mark.parametrize("seconds", [1, 1_000_000])
def test_hot_session_is_split_by_ranges(log, conf, seconds):
    """No range holds much of the hot session, even where all its events carry the same second."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    same = log.withColumn("ts", F.col("ts") % seconds)
    mine = same.where("session = 0").select("ts", "event_id").toPandas().sort_values(["ts", "event_id"])
    got = with_positions(same).where("session = 0").select("event_id", "position", "session_length").toPandas().sort_values("position")
    assert got.event_id.tolist() == mine.event_id.tolist() and got.position.tolist() == list(range(len(mine)))
    assert set(got.session_length) == {len(mine)}
    sizes = ranked_runs(same).where("session = 0").groupBy("run").count().toPandas()["count"]
    assert sizes.max() < 0.6 * sizes.sum()


def test_last_matrix_and_merge_bound_hot_keys(log, links, skewed, tmp_path, spark):
    """Sessions that end on a popular item are split; candidates are cut before the session shuffle."""
    i = F.col("id")
    ends = spark.range(60_000).select(i.alias("session"), F.when(i % 3 > 0, 0).otherwise(i % 997).cast("int").alias("aid"), i.alias("ts"), F.lit(0).alias("type"), i.alias("event_id"))
    ends.write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log").repartition(16)
    kinds = {k: stage(links, "links") for k in mx.KINDS}
    cands = stored.select("session", "aid")
    assert "skew=true" in plan(mx.features_matrix_last(cands, stored, kinds))
    own = log.select("session", "aid").distinct().withColumn("session_score", F.lit(1.0))
    more = log.select("session", (F.col("aid") + 1).alias("aid")).distinct().withColumn("wgt", F.lit(1))
    text = initial_plan(cand.merge_candidates(own, more, 10))
    assert "WindowGroupLimit" in text[text.index("== Physical Plan =="):]


@pytest.fixture()
def skewed(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16k",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="8",
    )


def test_hot_item_is_split_when_expanding(log, links, skewed, tmp_path):
    """Spark splits the hot item's partition of the edge join, so no task gets all its sessions."""
    log.write.parquet(f"{tmp_path}/log")
    spread = log.sparkSession.read.parquet(f"{tmp_path}/log").repartition(16)
    hits = cand.expand_by_edges(spread.select("session", "aid"), links)
    text = plan(hits.groupBy("session", "aid_y").count())
    assert "skew=true" in text


def test_hot_item_is_split_when_attaching_features(log, skewed):
    spread = log.repartition(16).select("session", "aid")
    items = stage(log.groupBy("aid").agg(F.count(F.lit(1)).alias("n")), "items")
    assert "skew=true" in plan(attach(spread, items, ["aid"]).groupBy("session").agg(F.sum("n")))


def test_hot_count_value_is_split_in_popularity(spark, skewed):
    """Most items share one count; the join with the rank table still splits."""
    items = spark.range(60_000).select(
        F.col("id").alias("aid"), F.when(F.col("id") % 50 == 0, F.col("id") % 700).otherwise(1).alias("n")
    ).repartition(16)
    ranked = ft.average_ranks(items, ["n"])
    assert ranked.count() == 60_000
    text = plan(ft.average_ranks(items, ["n"]).groupBy("aid").agg(F.max("rank_n")))
    assert "skew=true" in text


@pytest.mark.parametrize("kind", ["clicks", "buys"])
def test_session_items_are_shuffled_once_for_expansion_and_fillers(log, links, kind, tmp_path, spark):
    log.write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    out = cand.additional_clicks(stored, links, 20) if kind == "clicks" else cand.additional_buys(stored, links, links, 20)
    assert "ReusedExchange" in plan(out)


def test_log_is_pruned_and_filtered_in_the_scan(log, tmp_path, spark):
    log.withColumn("unused", F.lit("x")).write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    text = initial_plan(cv.covisit_buy2buy(stored))
    assert "PushedFilters: [In(type, [1,2])" in text or re.search(r"PushedFilters: \[.*type.*\]", text)
    assert "unused" not in text[text.index("== Physical Plan =="):]


def test_vector_session_joins_each_item_once(log, spark):
    vectors = spark.range(997).select(F.col("id").cast("int").alias("aid"), *[(F.col("id") * i % 5).cast("double").alias(f"svd_{i}") for i in range(10)])
    out = vec.features_vector_session(log, vectors)
    expected = log.where("session = 0").join(vectors, "aid").agg(F.avg("svd_3")).first()[0]
    assert out.where("session = 0").first()["svd_3_all"] == pytest.approx(expected)


def test_staged_tables_go_to_the_shared_folder(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert shared_dir(spark) == configured
    table, path = write_stage(spark.range(5), "five")
    assert path.startswith(shared_dir(spark)) and table.count() == 5
    drop_stage(spark, path)
    with pytest.raises(ValueError):
        drop_stage(spark, shared_dir(spark))


class FakeSession:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, None

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_unset_folder_is_an_error_on_a_cluster_only():
    assert shared_dir(FakeSession("local[4]")).startswith("spark-warehouse/shared-")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(FakeSession(master))


def test_session_defaults_do_not_override_the_caller(spark):
    assert build_session().conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_small_parts_of_sessions_are_not_put_together_before_pairs(spark, log):
    """The exchange that feeds the pairs keeps its number of parts, which adaptive execution would cut to the number of cores."""
    pairs = cv.session_pairs(log, 1000)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.search(rf"hashpartitioning\(session#\d+L?, {parts}\), REPARTITION_BY_NUM", plan(pairs))
    assert pairs.rdd.getNumPartitions() == parts
