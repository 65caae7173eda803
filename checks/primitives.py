"""Queries for sources, sinks, expressions and the single joins and aggregations the operators are made of."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basketweave.functions import events as ev
from basketweave.functions.lists import join_ids, parse_ids, parse_session, session_type
from basketweave.operators import candidates as cand
from basketweave.operators import features as ft
from basketweave.operators import learn
from basketweave.operators import matrix_features as mx
from basketweave.operators import recommend as rec
from basketweave.operators import vector_features as vec
from basketweave.operators.recency import last_event, with_positions
from basketweave.session import shared_dir
from basketweave.sources import tables
from checks import views as fx
from checks.features import TYPES, rate_sql
from checks.matrices_and_candidates import Inputs, edges
from checks.registry import query, rounded
from checks.sql import TYPE_W, sql, weight
from checks.views import K_RECALL, N_CANDIDATES, T0, T2


def folder(spark) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


# --- sources and sinks: write, then read back through the loader -------------------------------------------

EVENTS = "session, aid, ts, type, event_id"


@query("load_events_union", sql(f"SELECT {EVENTS} FROM fx_known"))
def load_events_union(spark, sf):
    root = folder(spark)
    tables.save_parquet(fx.fx_history(spark, sf), f"{root}/history")
    tables.save_parquet(fx.fx_observed(spark, sf), f"{root}/recent")
    return tables.load_events(spark, f"{root}/history", f"{root}/recent")


@query("load_events_window", sql(f"SELECT {EVENTS} FROM fx_observed"))
def load_events_window(spark, sf):
    root = folder(spark)
    tables.save_parquet(fx.fx_observed(spark, sf), f"{root}/recent")
    return tables.load_events(spark, f"{root}/recent")


@query("load_labels", sql("SELECT session, type, list_aggregate(ground_truth, 'string_agg', ' ') AS ground_truth FROM fx_labels"))
def load_labels(spark, sf):
    root = folder(spark)
    tables.save_parquet(fx.fx_labels(spark, sf), f"{root}/labels")
    return tables.load_labels(spark, f"{root}/labels").select(
        "session", "type", join_ids(F.col("ground_truth")).alias("ground_truth")
    )


@query("load_candidates", sql("SELECT session, aid FROM cand_buys"))
def load_candidates(spark, sf):
    root = folder(spark)
    tables.save_parquet(Inputs(spark, sf).merged("buys"), f"{root}/candidates/phase=train/family=buys")
    return tables.load_candidates(spark, root, "train", 1)


@query("load_covisit", sql("SELECT aid_x, aid_y, wgt FROM ev_typ"))
def load_covisit(spark, sf):
    root = folder(spark)
    made = edges(spark, sf, "buys")
    for part in (F.col("aid_x") % 2 == 0, F.col("aid_x") % 2 == 1):
        tables.save_parquet(made.where(part), f"{root}/covisit/phase=train/kind=buys", mode="append")
    return tables.load_covisit(spark, root, "train", "buys")


@query("load_item_vectors", sql("SELECT * FROM fx_item_vectors"))
def load_item_vectors(spark, sf):
    root = folder(spark)
    tables.save_parquet(fx.fx_item_vectors(spark, sf), f"{root}/item_vectors/phase=test")
    return tables.load_item_vectors(spark, root, "test")


query("scan_two_columns", "SELECT l_orderkey, l_partkey FROM lineitem")(
    lambda s, d: fx.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
)


@query("parquet_sink", sql("SELECT session, aid, ts, type FROM fx_baskets"))
def parquet_sink(spark, sf):
    path = f"{folder(spark)}/baskets"
    tables.save_parquet(fx.fx_baskets(spark, sf).drop("event_id"), path)
    return spark.read.parquet(path)


query("csv_sink_source", sql("SELECT session_type, labels FROM recs"))(
    lambda s, d: _csv_round_trip(s, Inputs(s, d).all_recommendations())
)


def _csv_round_trip(spark, df):
    path = f"{folder(spark)}/submission"
    tables.save_csv(df, path)
    return tables.load_submission(spark, path)


# --- expressions -------------------------------------------------------------------------------------------

query("filter_buys", sql(f"SELECT {EVENTS} FROM fx_events WHERE type IN (1, 2)"))(
    lambda s, d: fx.fx_events(s, d).where(ev.is_buy())
)
query("type_weight", sql(f"SELECT event_id, {TYPE_W} AS type_wgt FROM fx_events"))(
    lambda s, d: fx.fx_events(s, d).select("event_id", ev.type_weight().alias("type_wgt"))
)
query(
    "type_encode",
    sql("""SELECT event_id, type, CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END AS type_name, type AS type_id
      FROM fx_events"""),
)(
    lambda s, d: fx.fx_events(s, d)
    .select("event_id", "type", ev.type_name("type").alias("type_name"))
    .withColumn("type_id", ev.type_id("type_name"))
)
query(
    "time_weight",
    sql(f"SELECT event_id, round(1.0 + 3.0 * (ts - {T0}) / ({T2} - {T0}), 9) AS time_wgt FROM fx_known"),
)(
    lambda s, d: rounded(
        fx.fx_known(s, d).select("event_id", ev.time_weight("ts", T0, T2).alias("time_wgt")), "time_wgt", digits=9
    )
)
for _name, _start in (("buys", 0.5), ("clicks", 0.1)):
    query(f"log_position_weight_{_name}", sql(f"SELECT event_id, round({weight(_start)}, 9) AS log_time_wgt FROM pos"))(
        lambda s, d, a=_start: rounded(
            with_positions(fx.fx_observed(s, d)).select(
                "event_id",
                ev.position_weight(F.col("position"), F.col("session_length"), a).alias("log_time_wgt"),
            ),
            "log_time_wgt",
            digits=9,
        )
    )
query(
    "safe_rate",
    sql(f"""SELECT session, {rate_sql('carts', 'clicks')} AS carts_per_click, {rate_sql('orders', 'carts')} AS orders_per_cart
      FROM (SELECT session, count(*) FILTER (WHERE type = 0) AS clicks, count(*) FILTER (WHERE type = 1) AS carts,
        count(*) FILTER (WHERE type = 2) AS orders FROM fx_observed GROUP BY session)"""),
)(
    lambda s, d: _type_counts(fx.fx_observed(s, d)).select(
        "session",
        ev.safe_rate("carts", "clicks").alias("carts_per_click"),
        ev.safe_rate("orders", "carts").alias("orders_per_cart"),
    )
)


def _type_counts(events):
    return events.groupBy("session").agg(*[ft.count_type(t).alias(t) for t in TYPES])


query(
    "count_per_type",
    sql("""SELECT session, count(*) FILTER (WHERE type = 0) AS clicks, count(*) FILTER (WHERE type = 1) AS carts,
      count(*) FILTER (WHERE type = 2) AS orders FROM fx_events GROUP BY session"""),
)(lambda s, d: _type_counts(fx.fx_events(s, d)))
query(
    "column_diff",
    sql("""SELECT session, carts - clicks AS carts_clicks, orders - clicks AS orders_clicks, orders - carts AS orders_carts
      FROM (SELECT session, count(*) FILTER (WHERE type = 0) AS clicks, count(*) FILTER (WHERE type = 1) AS carts,
        count(*) FILTER (WHERE type = 2) AS orders FROM fx_observed GROUP BY session)"""),
)(
    lambda s, d: _type_counts(fx.fx_observed(s, d)).select(
        "session", *[(F.col(a) - F.col(b)).alias(f"{a}_{b}") for a, b in ft.RATE_PAIRS]
    )
)
query(
    "scale_phase", sql("SELECT aid_x AS session, aid_y AS aid, round(wgt * (7.0 / 9.0), 6) AS wgt FROM ev_typ")
)(
    lambda s, d: rounded(
        mx.scale_columns(
            edges(s, d, "buys").select(F.col("aid_x").alias("session"), F.col("aid_y").alias("aid"), "wgt"),
            mx.TEST_PHASE_SCALE,
        ),
        "wgt",
    )
)
query(
    "session_type_text",
    sql("SELECT DISTINCT session || '_orders' AS session_type FROM fx_observed"),
)(lambda s, d: fx.fx_observed(s, d).select(session_type("session", 2).alias("session_type")).distinct())
query(
    "parse_submission",
    sql("""SELECT CAST(string_split(session_type, '_')[1] AS BIGINT) AS session,
        CAST(string_split(labels, ' ')[1] AS BIGINT) AS first_id, least(len(string_split(labels, ' ')), 20) AS ids
      FROM rec_clicks"""),
)(
    lambda s, d: Inputs(s, d).recommendations()[0]
    .where(F.col("session_type").contains("clicks"))
    .select(parse_session("session_type").alias("session"), parse_ids("labels", 20).alias("ids"))
    .select("session", F.col("ids")[0].alias("first_id"), F.size("ids").alias("ids"))
)
query(
    "hits_per_label",
    sql(f"""SELECT l.session, l.type, len(list_intersect(l.ground_truth, coalesce(
          [CAST(x AS INTEGER) FOR x IN string_split(r.labels, ' ')][1:{K_RECALL}], []))) AS hits,
        least(len(l.ground_truth), {K_RECALL}) AS gt_count
      FROM fx_labels l LEFT JOIN recs r ON r.session_type = l.session || '_' || l.type"""),
)(lambda s, d: rec._hits(*Inputs(s, d).recommended_and_labels(), K_RECALL))
query(
    "l1_distance",
    sql("""SELECT vec_id AS aid, round(abs(svd_0 - svd_5) + abs(svd_1 - svd_6) + abs(svd_2 - svd_7), 6) AS distance
      FROM (SELECT aid AS vec_id, * FROM fx_item_vectors)"""),
)(
    lambda s, d: rounded(
        fx.fx_item_vectors(s, d).select(
            "aid", vec.l1_distance(["svd_0", "svd_1", "svd_2"], ["svd_5", "svd_6", "svd_7"]).alias("distance")
        ),
        "distance",
    )
)
query(
    "exists_flags",
    sql("""SELECT session, aid, max(CASE WHEN type = 0 THEN 1 ELSE 0 END) AS exists_clicks,
      max(CASE WHEN type = 1 THEN 1 ELSE 0 END) AS exists_carts, max(CASE WHEN type = 2 THEN 1 ELSE 0 END) AS exists_orders
      FROM fx_events GROUP BY session, aid"""),
)(
    lambda s, d: fx.fx_events(s, d)
    .groupBy("session", "aid")
    .agg(*[F.max((F.col("type") == t).cast("int")).alias(f"exists_{name}") for name, t in ev.TYPE_IDS.items()])
)

# --- joins -------------------------------------------------------------------------------------------------

# Fillers of sessions whose items have no edges at all: the top items that the session does not have.
query(
    "cross_top_items",
    sql(f"""SELECT session, aid, -k AS wgt FROM (
        SELECT s.session, t.aid, row_number() OVER (PARTITION BY s.session ORDER BY t.rank) AS k
        FROM (SELECT DISTINCT session FROM fx_observed) s CROSS JOIN (SELECT * FROM top_clicks WHERE rank <= {N_CANDIDATES}) t
        WHERE NOT EXISTS (SELECT 1 FROM fx_observed o WHERE o.session = s.session AND o.aid = t.aid))
      WHERE k <= {N_CANDIDATES}"""),
)(
    lambda s, d: cand.top_fillers(fx.fx_observed(s, d), 0, N_CANDIDATES)
)
query(
    "feature_attach",
    sql("""SELECT c.session, c.aid, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM cand_clicks c
      LEFT JOIN (SELECT aid, count(*) AS n FROM fx_observed GROUP BY aid) i ON c.aid = i.aid"""),
)(
    lambda s, d: learn.attach(
        Inputs(s, d).merged("clicks").select("session", "aid"),
        fx.fx_observed(s, d).groupBy("aid").agg(F.count(F.lit(1)).alias("n")),
        ["aid"],
    )
)
query(
    "pair_attach",
    sql("""SELECT c.session, c.aid, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM cand_clicks c
      LEFT JOIN (SELECT session, aid, count(*) AS n FROM fx_observed GROUP BY session, aid) i
      ON c.session = i.session AND c.aid = i.aid"""),
)(
    lambda s, d: learn.attach(
        Inputs(s, d).merged("clicks").select("session", "aid"),
        fx.fx_observed(s, d).groupBy("session", "aid").agg(F.count(F.lit(1)).alias("n")),
        ["session", "aid"],
    )
)
query(
    "last_item_edges",
    sql("""SELECT o.session, o.aid AS aid_last, e.aid_y, e.wgt
      FROM (SELECT session, arg_max(aid, (ts, event_id)) AS aid FROM fx_observed GROUP BY session) o
      LEFT JOIN ev_b2b e ON e.aid_x = o.aid"""),
)(
    lambda s, d: last_event(fx.fx_observed(s, d))
    .select("session", "aid_last")
    .join(edges(s, d, "buy2buy").withColumnRenamed("aid_x", "aid_last"), "aid_last", "left")
)
query(
    "events_with_edges",
    sql("SELECT o.session, o.event_id, e.aid_y, e.wgt FROM fx_observed o JOIN ev_typ e ON o.aid = e.aid_x"),
)(
    lambda s, d: fx.fx_observed(s, d)
    .join(edges(s, d, "buys"), F.col("aid") == F.col("aid_x"))
    .select("session", "event_id", "aid_y", "wgt")
)
query(
    "label_prediction_join",
    sql("""SELECT l.session, l.type, r.labels FROM fx_labels l LEFT JOIN recs r ON r.session_type = l.session || '_' || l.type"""),
)(
    lambda s, d: fx.fx_labels(s, d)
    .withColumn("session_type", F.concat_ws("_", "session", "type"))
    .join(Inputs(s, d).all_recommendations(), "session_type", "left")
    .select("session", "type", "labels")
)

# --- aggregations ------------------------------------------------------------------------------------------

query("edge_hits_count", sql("SELECT session, aid_y, count(*) AS wgt FROM add_hits_buys GROUP BY session, aid_y"))(
    lambda s, d: _edge_hit_counts(s, d)
)


def _edge_hit_counts(spark, sf):
    seen = fx.fx_observed(spark, sf)
    own = seen.select("session", "aid").distinct()
    bought = seen.where(ev.is_buy()).select("session", "aid").distinct()
    hits = cand.expand_by_edges(own, edges(spark, sf, "buys")).unionByName(
        cand.expand_by_edges(bought, edges(spark, sf, "buy2buy"))
    )
    return hits.groupBy("session", "aid_y").agg(F.count(F.lit(1)).alias("wgt"))


query(
    "matrix_stats",
    sql("""SELECT session, aid_y AS aid, round(avg(wgt), 6) AS mean, min(wgt) AS min, max(wgt) AS max, median(wgt) AS median, sum(wgt) AS sum
      FROM fx_observed o JOIN ev_typ e ON o.aid = e.aid_x GROUP BY session, aid_y"""),
)(lambda s, d: _matrix_stats(s, d))


def _matrix_stats(spark, sf):
    """Statistics of every reached item, that is with the reached items themselves as candidates."""
    seen, by_kind = fx.fx_observed(spark, sf), {"buys": Inputs(spark, sf).edges("buys")}
    reached = (
        cand.expand_by_edges(seen.select("session", "aid").distinct(), by_kind["buys"])
        .select("session", F.col("aid_y").alias("aid"))
        .distinct()
    )
    stats = mx.features_matrix(reached, seen, by_kind)
    names = {s: f"wgt_buys_{s}_all" for s in ("mean", "min", "max", "median")} | {"sum": "wgt_buys_sum_lastall"}
    return rounded(stats.select("session", "aid", *[F.col(c).alias(n) for n, c in names.items()]), "mean")


query(
    "mean_vector",
    sql("SELECT session, round(avg(svd_0), 6) AS svd_0_all FROM fx_observed o JOIN fx_item_vectors v ON o.aid = v.aid GROUP BY session"),
)(
    lambda s, d: rounded(
        vec.features_vector_session(fx.fx_observed(s, d), fx.fx_item_vectors(s, d)).select("session", "svd_0_all"),
        "svd_0_all",
    )
)
query("last_event_ts", sql("SELECT session, aid, max(ts) AS last_event_ts FROM fx_events GROUP BY session, aid"))(
    lambda s, d: fx.fx_events(s, d).groupBy("session", "aid").agg(F.max("ts").alias("last_event_ts"))
)
query("session_length", sql("SELECT session, count(*) AS session_length FROM fx_events GROUP BY session"))(
    lambda s, d: fx.fx_events(s, d).groupBy("session").agg(F.count(F.lit(1)).alias("session_length"))
)
query("unique_items", sql("SELECT DISTINCT aid FROM fx_baskets"))(
    lambda s, d: fx.fx_baskets(s, d).select("aid").distinct()
)
query("sorted_submission", sql("SELECT session_type, labels FROM rec_carts ORDER BY session_type"))(
    lambda s, d: rec.make_recommendations(Inputs(s, d).ranked("buys"), 1).orderBy("session_type")
)
query("union_sources", sql("SELECT session, aid, session_score IS NULL AS added FROM cand_buys"))(
    lambda s, d: Inputs(s, d).merged("buys").select("session", "aid", F.isnull("session_score").alias("added"))
)
