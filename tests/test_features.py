import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketweave.functions.events import safe_rate
from basketweave.operators import features as ft
from basketweave.operators import matrix_features as mx
from basketweave.operators import quality
from basketweave.operators import vector_features as vec
from tests.conftest import rows
from tests.test_covisit import random_log


def test_rates_with_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (1, 4)], "a INT, b INT")
    assert [r[0] for r in df.select(safe_rate("a", "b")).collect()] == [0.0, 100_000_000.0, 0.25]


def test_popularity_is_the_average_rank(spark, events):
    log = random_log(5, items=15)
    counts = Counter(a for _, a, _, _ in log)
    series = pd.Series(counts)
    expected = sorted((a, v) for a, v in (series.rank() / len(series)).items())
    assert rows(ft.popularity(events(log))) == [(a, pytest.approx(v)) for a, v in expected]


def test_feature_counts_and_no_missing_values(events, edges, spark):
    log = random_log(2)
    df = events(log)
    candidates = df.select("session", "aid").distinct().withColumn("candidate_pos", F.col("aid") % 5)
    links = edges([(x, y, x + y) for x in range(9) for y in range(9) if x != y])
    vectors = spark.createDataFrame(
        [(a, *[float((a * i) % 7) for i in range(10)]) for a in range(9)],
        "aid INT, " + ", ".join(f"svd_{i} DOUBLE" for i in range(10)),
    )
    item, session = vec.features_vector_item(vectors), vec.features_vector_session(df, vectors)
    all_edges = {k: links for k in mx.KINDS}
    tables = [
        (ft.features_item(df, df.where("ts > 100000")), 1, 30),
        (ft.features_session(df), 1, 53),
        (ft.features_session_item(candidates, df), 2, 34),
        (mx.features_matrix(candidates, df, all_edges), 2, 30),
        (mx.features_matrix_last(candidates, df, all_edges), 2, 3),
        (item, 1, 10),
        (session, 1, 30),
        (vec.features_vector_pair(candidates, item, session), 2, 33),
    ]
    for table, keys, n in tables:
        assert len(table.columns) == keys + n
        quality.assert_clean(table)
    assert sum(n for _, _, n in tables) == 223


def test_matrix_statistics_equal_brute_force(events, edges):
    log = random_log(4, sessions=5)
    links = [(x, y, (x * 5 + y * 3) % 11 + 1) for x in range(9) for y in range(9) if x != y and (x + y) % 3]
    df = events(log)
    candidates = df.select("session").distinct().crossJoin(df.select("aid").distinct())
    got = mx.features_matrix(candidates, df, {"buys": edges(links)}, last=5).collect()
    for r in got:
        mine = sorted((ts, i, a) for i, (s, a, ts, _) in enumerate(log) if s == r["session"])
        for label, part in (("all", mine), ("5", mine[-5:])):
            w = [float(wgt) for _, _, a in part for x, y, wgt in links if x == a and y == r["aid"]] or [0.0]
            stats = (statistics.mean(w), min(w), max(w), statistics.median(w), sum(w))
            names = [f"wgt_buys_{s}_{label}" for s in ("mean", "min", "max", "median")] + [f"wgt_buys_sum_last{label}"]
            assert [r[n] for n in names] == pytest.approx(stats), (r["session"], r["aid"], label)


def test_last_item_edge_is_cut_to_an_integer_and_scaled(events, spark):
    df = events([(1, 7, 0, 0), (1, 3, 5, 0)])
    links = spark.createDataFrame([(3, 9, 4.75), (7, 9, 100.0)], "aid_x INT, aid_y INT, wgt DOUBLE")
    candidates = spark.createDataFrame([(1, 9), (1, 7)], "session BIGINT, aid INT")
    out = mx.features_matrix_last(candidates, df, {"clicks": links}, scale=0.5)
    assert rows(out, "aid", "cvm_weight_clicks_last1") == [(7, 0.0), (9, 2.0)]


def test_session_vectors_skip_items_without_a_vector(events, spark):
    df = events([(1, 1, 0, 0), (1, 2, 1, 0), (1, 99, 2, 0)])
    vectors = spark.createDataFrame([(1, 2.0), (2, 6.0)], "aid INT, svd_0 DOUBLE")
    out = vec.features_vector_session(df, vectors)
    assert rows(out) == [(1, 6.0, 4.0, 4.0)]


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("inf")), (None, 2.0)], "a INT, b DOUBLE")
    assert rows(quality.quality_report(df)) == [("a", 1, 0), ("b", 0, 1)]
    with pytest.raises(ValueError, match="a, b"):
        quality.assert_clean(df)


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(126, 127, 40_000, 2**40, 1.5, "x"), (0, 0, 0, 0, 1e300, "y")],
        "a BIGINT, b BIGINT, c BIGINT, d BIGINT, e DOUBLE, f STRING",
    )
    assert [t for _, t in quality.narrow_types(df).dtypes] == ["tinyint", "smallint", "int", "bigint", "double", "string"]
    assert dict(quality.narrow_types(df.limit(1)).dtypes)["e"] == "float"


def test_few_narrow_candidates_are_not_widened_by_one_task(spark, conf):
    """candidates are small as keys, so one task made the hundreds of columns of all of them."""
    conf(spark__sql__shuffle__partitions="8")
    vectors = spark.createDataFrame([(a, float(a), 1.0 - a) for a in range(9)], "aid INT, svd_0 DOUBLE, svd_1 DOUBLE")
    events = spark.range(400).selectExpr("id % 80 AS session", "CAST(id % 9 AS INT) AS aid", "id AS ts", "0 AS type", "id AS event_id")
    item, session = vec.features_vector_item(vectors), vec.features_vector_session(events, vectors)
    pairs = events.select("session", F.col("aid")).distinct().unionByName(spark.createDataFrame([(999, 99)], "session BIGINT, aid INT")).coalesce(1)
    out = vec.features_vector_pair(pairs, item, session)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert out.count() == pairs.count()
    assert rows(out.where("session = 999").drop("session", "aid")) == [(0.0,) * 9]
    both = out.join(item, "aid").join(session, "session")
    off = "abs(svd_1_diff_candidates_all - (svd_1_candidates - svd_1_all)) > 1e-12"
    assert both.where(off + " OR abs(svd_total_diff_candidates_last1 - abs(svd_0_candidates - svd_0_last1) - abs(svd_1_candidates - svd_1_last1)) > 1e-12").count() == 0
