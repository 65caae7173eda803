"""Queries for edges, candidates, labels, recommendation lists and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketweave.functions.events import is_buy
from basketweave.operators import candidates as cand
from basketweave.operators import covisit as cv
from basketweave.operators import recommend as rec
from basketweave.operators.recency import last_event, latest_events, with_positions
from basketweave.session import stage
from checks import views as fx
from checks.registry import query, rounded
from checks.sql import DAY, define_edges, recent_of, pairs_of, sql
from checks.views import K_EDGES, K_RECALL, N_ADDITIONAL, N_CANDIDATES, T0, T2


def edges(spark, sf, kind, k=K_EDGES):
    return edges_of(fx.fx_known(spark, sf), kind, k)


def edges_of(known, kind, k=K_EDGES):
    if kind == "buy2buy":
        return cv.covisit_buy2buy(known, k=k)
    if kind == "buys":
        return cv.covisit_type_weighted(known, k=k)
    return cv.covisit_time_weighted(known, T0, T2, k=k)


class Inputs:
    """Inputs of one query. The log, its positions, edges and candidates feed several operators, so each is written once."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self.made = spark, sf, {}
        self.log = self._once("log", lambda: fx.fx_events(spark, sf))
        self.observed, self.known, self.labels = fx.observed(self.log), fx.known(self.log), fx.labels(self.log)

    def _once(self, name, make):
        if name not in self.made:
            self.made[name] = stage(make(), name)
        return self.made[name]

    def edges(self, kind, k=K_EDGES):
        return self._once(f"{kind}-{k}", lambda: edges_of(self.known, kind, k))

    def share_pairs(self):
        """Type- and time-weighted edges from one pass over the pairs, for queries that use both."""
        day = self._once("day-weights", lambda: cv.day_weights(self.known, T0, T2))
        for kind, wgt in (("buys", "wgt_type"), ("clicks", "wgt_time")):
            self._once(f"{kind}-{K_EDGES}", lambda w=wgt: cv.top_edges(day.select("aid_x", "aid_y", F.col(w).alias("wgt")), K_EDGES))

    def positioned(self):
        return self._once("positions", lambda: with_positions(self.observed))

    def all_edges(self):
        self.share_pairs()
        return {kind: self.edges(kind) for kind in ("buys", "buy2buy", "clicks")}

    def additional(self, family, n=N_ADDITIONAL, k=K_EDGES):
        if family == "clicks":
            return cand.additional_clicks(self.observed, self.edges("clicks", k), n)
        return cand.additional_buys(self.observed, self.edges("buys", k), self.edges("buy2buy", k), n)

    def session_candidates(self, family):
        if family == "clicks":
            return cand.session_score_clicks(self.positioned())
        return cand.session_score_buys(self.positioned(), self.edges("buy2buy"))

    def merged(self, family):
        return cand.merge_candidates(self.session_candidates(family), self.additional(family), N_CANDIDATES)

    def candidates(self, family):
        return self._once(f"candidates-{family}", lambda: self.merged(family))

    def labelled(self):
        return cand.label_candidates(
            self.candidates("buys").select("session", "aid", "candidate_pos"), 2, self.labels
        )

    def ranked(self, family):
        return self.candidates(family).select("session", "aid", (-F.col("candidate_pos")).cast("double").alias("score"))

    def recommendations(self):
        self.share_pairs()
        return [
            rec.make_recommendations(self.ranked("clicks"), 0),
            rec.make_recommendations(self.ranked("buys"), 1),
            rec.make_recommendations(self.ranked("buys"), 2),
        ]

    def all_recommendations(self):
        clicks, carts, orders = self.recommendations()
        return clicks.unionByName(carts).unionByName(orders)

    def recommended_and_labels(self):
        return self.all_recommendations(), self.labels


# --- edges -------------------------------------------------------------------------------------------------

query("covisit_buy2buy", sql("SELECT aid_x, aid_y, wgt FROM ev_b2b"))(lambda s, d: edges(s, d, "buy2buy"))
query("covisit_type_weighted", sql("SELECT aid_x, aid_y, wgt FROM ev_typ"))(lambda s, d: edges(s, d, "buys"))
query("covisit_time_weighted", sql("SELECT aid_x, aid_y, wgt FROM ev_clk"))(lambda s, d: edges(s, d, "clicks"))

B0, B1 = 788_918_400, 996_624_000  # 1995-01-01 and 2001-08-01
define_edges("bk", "fx_baskets", B0, B1, 40)
query("covisit_buy2buy_baskets", sql("SELECT aid_x, aid_y, wgt FROM bk_b2b"))(
    lambda s, d: cv.covisit_buy2buy(fx.fx_baskets(s, d))
)
query("covisit_type_weighted_baskets", sql("SELECT aid_x, aid_y, wgt FROM bk_typ"))(
    lambda s, d: cv.covisit_type_weighted(fx.fx_baskets(s, d))
)
query("covisit_time_weighted_baskets", sql("SELECT aid_x, aid_y, wgt FROM bk_clk"))(
    lambda s, d: cv.covisit_time_weighted(fx.fx_baskets(s, d), B0, B1)
)
query("session_recent", f"{sql('SELECT session, aid, ts, type, event_id, recency FROM ev_all30')}")(
    lambda s, d: latest_events(fx.fx_known(s, d), 30).select("session", "aid", "ts", "type", "event_id", "recency")
)
query("session_pairs", sql("SELECT session, aid_x, aid_y, ts_x, type_y FROM ev_day_pairs"))(
    lambda s, d: cv.session_pairs(fx.fx_known(s, d), DAY)
)
query("pair_distinct", sql("SELECT DISTINCT session, aid_x, aid_y, type_y FROM ev_day_pairs"))(
    lambda s, d: cv.distinct_pairs(cv.session_pairs(fx.fx_known(s, d), DAY), "type_y")
)
query("pair_count", sql("SELECT aid_x, aid_y, wgt FROM ev_b2b_w"))(lambda s, d: cv.buy2buy_weights(fx.fx_known(s, d)))
query("pair_weighted_sum", sql("SELECT aid_x, aid_y, wgt FROM ev_typ_w"))(
    lambda s, d: cv.type_weights(fx.fx_known(s, d))
)
query(
    "pair_weights_one_pass",
    sql("""SELECT t.aid_x, t.aid_y, t.wgt AS wgt_type, c.wgt AS wgt_time
      FROM ev_typ_w t JOIN ev_clk_w c ON t.aid_x = c.aid_x AND t.aid_y = c.aid_y"""),
)(lambda s, d: cv.day_weights(fx.fx_known(s, d), T0, T2))
query("topk_edges", sql("SELECT aid_x, aid_y, wgt FROM ev2_typ"))(lambda s, d: edges(s, d, "buys", 2))


@query("merge_covisit", sql("SELECT aid_x, aid_y, wgt FROM ev_typ"))
def merge_covisit(spark, sf):
    known = fx.fx_known(spark, sf)
    odd = F.col("session") % 2 == 1
    return cv.top_edges(cv.merge_edges(cv.type_weights(known.where(odd)), cv.type_weights(known.where(~odd))), K_EDGES)


# --- order within a session --------------------------------------------------------------------------------

query("session_last", sql("""SELECT session, arg_max(aid, (ts, event_id)) AS aid_last, arg_max(type, (ts, event_id)) AS type_last
  FROM fx_observed GROUP BY session"""))(lambda s, d: last_event(fx.fx_observed(s, d)))
query("session_tail_n", sql(f"SELECT session, aid, ts, type, recency FROM ({recent_of('fx_observed', 10)})"))(
    lambda s, d: latest_events(fx.fx_observed(s, d), 10).select("session", "aid", "ts", "type", "recency")
)
query("session_positions", sql("SELECT session, aid, ts, event_id, position, session_length FROM pos"))(
    lambda s, d: with_positions(fx.fx_observed(s, d)).drop("type")
)
# The same with every session of more than five events split by second.
query("session_positions_split", sql("SELECT session, aid, ts, event_id, position, session_length FROM pos"))(
    lambda s, d: with_positions(fx.fx_observed(s, d)).drop("type")
)

# --- candidates --------------------------------------------------------------------------------------------

query("score_session_items", sql("SELECT session, aid, round(session_score, 6) AS session_score FROM sc_clicks_all"))(
    lambda s, d: rounded(
        cand.session_score_clicks(fx.fx_observed(s, d), max_n=1_000_000).select("session", "aid", "session_score"),
        "session_score",
    )
)
query("session_score_buys", sql("SELECT session, aid, round(session_score, 6) AS session_score FROM sc_buys"))(
    lambda s, d: rounded(Inputs(s, d).session_candidates("buys"), "session_score")
)
CLICK_COLUMNS = "session_length, last_event_ts, exists_clicks, exists_carts, exists_orders"
query(
    "session_score_clicks",
    sql(f"SELECT session, aid, round(session_score, 6) AS session_score, {CLICK_COLUMNS} FROM sc_clicks"),
)(lambda s, d: rounded(cand.session_score_clicks(fx.fx_observed(s, d)), "session_score"))
query(
    "session_newest_items",
    sql("""SELECT session, aid, last_event_ts FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY last_event_ts DESC, aid) AS n
      FROM sc_clicks_all) WHERE n <= 5"""),
)(lambda s, d: cand.session_score_clicks(fx.fx_observed(s, d), max_n=5).select("session", "aid", "last_event_ts"))
query("top_items", sql("SELECT aid, rank FROM top_clicks WHERE rank <= 20"))(
    lambda s, d: cand.top_items(fx.fx_observed(s, d), 0, 20)
)
query(
    "sessions_under_limit",
    sql("SELECT session, count(*) AS n_items, CAST(sum(bought) AS BIGINT) AS n_bought FROM fil_own GROUP BY session"),
)(
    lambda s, d: cand.limited_sessions(fx.fx_observed(s, d), 8)
    .groupBy("session")
    .agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("bought").cast("int")).alias("n_bought"))
)
query(
    "distinct_session_items", sql("SELECT DISTINCT session, aid FROM fx_observed")
)(lambda s, d: fx.fx_observed(s, d).select("session", "aid").distinct())
query(
    "expand_by_matrix",
    sql("SELECT b.session, e.aid_y, e.wgt FROM (SELECT DISTINCT session, aid FROM fx_observed) b JOIN ev_b2b e ON b.aid = e.aid_x"),
)(
    lambda s, d: cand.expand_by_edges(
        fx.fx_observed(s, d).select("session", "aid").distinct(), edges(s, d, "buy2buy")
    )
)
query("additional_clicks", sql("SELECT session, aid, wgt FROM add_clicks"))(
    lambda s, d: Inputs(s, d).additional("clicks")
)
query("additional_buys", sql("SELECT session, aid, wgt FROM add_buys"))(
    lambda s, d: Inputs(s, d).additional("buys")
)
# Two edges per item and a limit of eight: most sessions need fillers, and some are over the limit.
query("additional_clicks_fillers", sql("SELECT session, aid, wgt FROM fil_clicks"))(
    lambda s, d: Inputs(s, d).additional("clicks", 8, 2)
)
query("additional_buys_fillers", sql("SELECT session, aid, wgt FROM fil_buys"))(
    lambda s, d: Inputs(s, d).additional("buys", 8, 2)
)


def _anti_existing(inputs):
    return cand.anti_existing(inputs.additional("clicks"), inputs.session_candidates("clicks"))


query(
    "anti_existing",
    sql("""SELECT a.session, a.aid, a.wgt FROM add_clicks a
      WHERE NOT EXISTS (SELECT 1 FROM sc_clicks s WHERE s.session = a.session AND s.aid = a.aid)"""),
)(lambda s, d: _anti_existing(Inputs(s, d)))
CANDIDATE_SQL = "SELECT session, aid, round(session_score, 6) AS session_score, wgt, candidate_pos FROM "
query("merge_candidates_buys", sql(CANDIDATE_SQL + "cand_buys"))(
    lambda s, d: rounded(Inputs(s, d).merged("buys"), "session_score")
)
query("merge_candidates_clicks", sql(CANDIDATE_SQL + "cand_clicks"))(
    lambda s, d: rounded(Inputs(s, d).merged("clicks"), "session_score")
)
query(
    "describe_candidates",
    sql("""SELECT count(*) AS count, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS std, min(n) AS min,
      quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS max
      FROM (SELECT session, count(DISTINCT aid) AS n FROM sc_clicks GROUP BY session)"""),
)(
    lambda s, d: rounded(
        cand.candidates_per_session(Inputs(s, d).session_candidates("clicks").select("session", "aid")), "mean", "std"
    )
)
query("explode_labels", sql("SELECT session, type, aid, target FROM truth"))(
    lambda s, d: cand.explode_labels(fx.fx_labels(s, d))
)


def labelled(spark, sf):
    return Inputs(spark, sf).labelled()


query("label_candidates", sql("SELECT session, aid, candidate_pos, type, target FROM labelled"))(labelled)
query(
    "label_candidates_unlabelled", sql("SELECT session, aid, 0 AS type, 0 AS target FROM cand_clicks")
)(lambda s, d: cand.label_candidates(Inputs(s, d).merged("clicks").select("session", "aid"), 0))


# --- recommendation lists and evaluation -------------------------------------------------------------------

query("make_recommendations", sql("SELECT session_type, labels FROM rec_orders"))(
    lambda s, d: rec.make_recommendations(Inputs(s, d).ranked("buys"), 2)
)
query("top_scored", sql("SELECT session, aid, candidate_pos + 1 AS n FROM cand_clicks WHERE candidate_pos < 5"))(
    lambda s, d: rec.top_scored(Inputs(s, d).ranked("clicks"), 5).select("session", "aid", "n")
)

RECALL = f"""SELECT l.type, CAST(sum(len(list_intersect(l.ground_truth, coalesce(
      [CAST(x AS INTEGER) FOR x IN string_split(r.labels, ' ')][1:{K_RECALL}], [])))) AS BIGINT) AS hits,
    CAST(sum(least(len(l.ground_truth), {K_RECALL})) AS BIGINT) AS gt_count
  FROM fx_labels l LEFT JOIN recs r ON r.session_type = l.session || '_' || l.type"""
query(
    "recall_by_type",
    sql(f"SELECT type, hits, gt_count, hits / gt_count AS recall FROM ({RECALL} GROUP BY l.type)"),
)(lambda s, d: rec.recall_by_type(*Inputs(s, d).recommended_and_labels(), K_RECALL))
query(
    "recall_at_k",
    sql(f"SELECT type, hits, gt_count, hits / gt_count AS recall FROM ({RECALL} WHERE l.type = 'orders' GROUP BY l.type)"),
)(lambda s, d: rec.recall_at(*Inputs(s, d).recommended_and_labels(), 2, K_RECALL))
query(
    "weighted_score",
    sql(f"""SELECT recall_clicks, recall_carts, recall_orders,
        round(0.1 * recall_clicks + 0.3 * recall_carts + 0.6 * recall_orders, 9) AS score
      FROM (SELECT max(CASE WHEN type = 'clicks' THEN hits / gt_count END) AS recall_clicks,
          max(CASE WHEN type = 'carts' THEN hits / gt_count END) AS recall_carts,
          max(CASE WHEN type = 'orders' THEN hits / gt_count END) AS recall_orders
        FROM ({RECALL} GROUP BY l.type))"""),
)(
    lambda s, d: rounded(
        rec.weighted_score(*Inputs(s, d).recommended_and_labels(), K_RECALL), "score", digits=9
    )
)
_CUT = "CASE WHEN length(labels) <= 30 THEN labels ELSE regexp_replace(substring(labels || ' ', 1, 31), ' [^ ]*$', '') END"
query(
    "concat_submissions",
    sql(f"""SELECT session_type, labels FROM rec_clicks
      UNION ALL SELECT session_type, {_CUT} AS labels FROM rec_carts
      UNION ALL SELECT session_type, {_CUT} AS labels FROM rec_orders"""),
)(lambda s, d: rec.concat_submissions(*Inputs(s, d).recommendations(), limit=30))
