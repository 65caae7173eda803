"""Queries for item, session, pair, matrix and vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketweave.operators import features as ft
from basketweave.operators import matrix_features as mx
from basketweave.operators import vector_features as vec
from checks import views as fx
from checks.matrices_and_candidates import Inputs
from checks.registry import query, rounded
from checks.sql import cte, recent_of, sql
from checks.views import VECTOR_DIMS

TYPES = {"clicks": 0, "carts": 1, "orders": 2}
PAIRS = (("carts", "clicks"), ("orders", "clicks"), ("orders", "carts"))
RATES = [f"{t}_rate_per_action" for t in TYPES] + [f"{a}_rate_per_{b}" for a, b in PAIRS]
LAST_ROWS = (3, 10, 30)


def rate_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} <> 0 THEN CAST({num} AS DOUBLE) / ({den}) WHEN {num} = 0 THEN 0.0 ELSE 100000000.0 END"


def rates_sql(prefix: str, suffix: str) -> list[str]:
    """Rates over ``<type>_count<suffix>`` columns."""
    n = {t: f"{prefix}{t}_count{suffix}" for t in TYPES}
    total = f"({n['clicks']} + {n['carts']} + {n['orders']})"
    out = [f"{rate_sql(n[t], total)} AS {t}_rate_per_action{suffix}" for t in TYPES]
    return out + [f"{rate_sql(n[a], n[b])} AS {a}_rate_per_{b}{suffix}" for a, b in PAIRS]


# --- items -------------------------------------------------------------------------------------------------

def counts_sql(src: str, suffix: str) -> str:
    cols = ", ".join(
        f"(SELECT count(*) FROM {src} e WHERE e.aid = i.aid AND e.type = {t}) AS {name}_count{suffix}" for name, t in TYPES.items()
    )
    return f"SELECT aid, {cols} FROM (SELECT DISTINCT aid FROM fx_known) i"


def ranks_sql(suffix: str) -> list[str]:
    total = " + ".join(f"{t}_count{suffix}" for t in TYPES)
    values = {"all_actions": f"({total})", **{t: f"{t}_count{suffix}" for t in TYPES}}
    # average rank: smallest rank of the value plus half of the other rows that share it
    return [
        f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count(*) OVER () AS popularity_{p}{suffix}"
        for p, v in values.items()
    ]


for _suffix, _src in (("", "fx_known"), ("_last1week", "fx_observed")):
    cte(f"item_counts{_suffix}", counts_sql(_src, _suffix))
    cte(
        f"item_levels{_suffix}",
        f"SELECT aid, {', '.join(rates_sql('', _suffix) + ranks_sql(_suffix))} FROM item_counts{_suffix}",
    )
POPULARITY = ("all_actions", "clicks", "carts", "orders")
_changes = [
    f"popularity_{p}_last1week - popularity_{p} AS popularity_{'all' if p == 'all_actions' else p}_diff_from_all_to_last1week"
    for p in POPULARITY
] + [f"{r} - {r}_last1week AS {r}_diff_from_all_to_last1week" for r in RATES]
ITEM_LEVELS = [f"{r}{s}" for s in ("", "_last1week") for r in (*RATES, *(f"popularity_{p}" for p in POPULARITY))]
cte(
    "item_feats",
    f"SELECT a.aid, {', '.join(ITEM_LEVELS)}, {', '.join(_changes)} FROM item_levels a JOIN item_levels_last1week b ON a.aid = b.aid",
)
ITEM_COLUMNS = ITEM_LEVELS + [c.split(" AS ")[1] for c in _changes]
POPULARITY_COLUMNS = [c for c in ITEM_COLUMNS if "popularity" in c]


def round_all(df, keys):
    return rounded(df, *[c for c in df.columns if c not in keys])


def sql_round_all(columns, keys, src):
    return sql(f"SELECT {', '.join(keys)}, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM {src}")


query("features_item", sql_round_all(ITEM_COLUMNS, ["aid"], "item_feats"))(
    lambda s, d: round_all(ft.features_item(fx.fx_known(s, d), fx.fx_observed(s, d)), ("aid",))
)
query("popularity", sql("SELECT aid, round(popularity_orders, 6) AS popularity FROM item_levels"))(
    lambda s, d: rounded(ft.popularity(fx.fx_known(s, d), 2), "popularity")
)
cte("bk_counts", "SELECT l_partkey AS aid, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
query(
    "popularity_baskets",
    sql("""SELECT aid, round((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER (), 6) AS popularity
      FROM bk_counts"""),
)(lambda s, d: rounded(ft.popularity(fx.fx_baskets(s, d)), "popularity"))
query(
    "type_counts_item",
    sql("SELECT aid, clicks_count, carts_count, orders_count FROM item_counts"),
)(lambda s, d: fx.fx_known(s, d).groupBy("aid").agg(*[ft.count_type(t).alias(f"{t}_count") for t in TYPES]))

# --- sessions ----------------------------------------------------------------------------------------------

cte("obs_ranked", recent_of("fx_observed", 1_000_000_000))
_sets = {"all": ("_of_session", "TRUE"), **{str(n): (f"_of_session_{n}", f"recency <= {n}") for n in LAST_ROWS}}
cte(
    "session_counts",
    "SELECT session, max(CASE WHEN recency = 1 THEN type END) AS last_type_of_session, "
    + ", ".join(
        f"count(*) FILTER (WHERE type = {t} AND {cond}) AS {name}_count{suffix}"
        for suffix, cond in _sets.values()
        for name, t in TYPES.items()
    )
    + " FROM obs_ranked GROUP BY session",
)
_session_levels, SESSION_COLUMNS = [], []
for _key, (_suffix, _cond) in _sets.items():
    _session_levels += [f"{t}_count{_suffix}" for t in TYPES]
    _session_levels.append(" + ".join(f"{t}_count{_suffix}" for t in TYPES) + f" AS total_action_count{_suffix}")
    _session_levels += rates_sql("", _suffix)
_session_levels.append("last_type_of_session")
cte("session_levels", f"SELECT session, {', '.join(_session_levels)} FROM session_counts")
SESSION_COLUMNS = [c.split(" AS ")[-1] if " AS " in c else c for c in _session_levels]
_diffs = [f"{r}_of_session_3 - {r}_of_session_{n} AS {r}_of_session_diff_3_{n}" for n in (10, 30) for r in RATES]
SESSION_COLUMNS = [c.rsplit(" AS ", 1)[-1] for c in _session_levels + _diffs]
cte("session_feats", f"SELECT *, {', '.join(_diffs)} FROM session_levels")
query("features_session", sql_round_all(SESSION_COLUMNS, ["session"], "session_feats"))(
    lambda s, d: round_all(ft.features_session(fx.fx_observed(s, d)), ("session",))
)

# --- candidate pairs ---------------------------------------------------------------------------------------

_pair_sets = {"all": "TRUE", **{f"last{n}rows": f"recency <= {n}" for n in LAST_ROWS}}
cte(
    "pair_counts",
    "SELECT session, aid, "
    + ", ".join(
        f"count(*) FILTER (WHERE type = {t} AND {cond}) AS {name}_{key}"
        for key, cond in _pair_sets.items()
        for name, t in TYPES.items()
    )
    + " FROM obs_ranked GROUP BY session, aid",
)
_base, _out = [], []
for _key in _pair_sets:
    for _t in TYPES:
        _base.append(f"coalesce({_t}_{_key}, 0) AS {_t}_count_{_key}")
        _out.append(f"{_t}_count_{_key}")
    for _a, _b in PAIRS:
        _out.append(f"{_a}_count_{_key} - {_b}_count_{_key} AS {_a}_count_diff_from_{_b}_{_key}")
for _t in TYPES:
    for _a, _b in (("last3rows", "last10rows"), ("last10rows", "last30rows"), ("last30rows", "all")):
        _out.append(f"{_t}_count_{_a} - {_t}_count_{_b} AS {_t}_count_diff_{_a}_{_b}")
cte(
    "pair_base",
    f"""SELECT c.session, c.aid, c.candidate_pos + 1 AS candidates_rank, {', '.join(_base)}
      FROM cand_buys c LEFT JOIN pair_counts p ON c.session = p.session AND c.aid = p.aid""",
)
PAIR_COLUMNS = ["candidates_rank"] + [c.rsplit(" AS ", 1)[-1] for c in _out]
query("features_session_item", sql(f"SELECT session, aid, candidates_rank, {', '.join(_out)} FROM pair_base"))(
    lambda s, d: session_item(s, d)
)
query("candidate_rank", sql("SELECT session, aid, candidate_pos + 1 AS candidates_rank FROM cand_buys"))(
    lambda s, d: Inputs(s, d).merged("buys").select("session", "aid", (F.col("candidate_pos") + 1).alias("candidates_rank"))
)

# --- matrix features ---------------------------------------------------------------------------------------

EDGE_CTES = {"buys": "ev_typ", "buy2buy": "ev_b2b", "clicks": "ev_clk"}


def matrix_features(spark, sf):
    made = Inputs(spark, sf)
    return mx.features_matrix(made.candidates("buys"), made.observed, made.all_edges())


def matrix_last(spark, sf):
    made = Inputs(spark, sf)
    return mx.features_matrix_last(made.candidates("buys"), made.observed, made.all_edges())


def session_item(spark, sf):
    made = Inputs(spark, sf)
    return ft.features_session_item(made.candidates("buys"), made.observed)


MATRIX_COLUMNS: dict[str, list[str]] = {}
for _label, _cond in (("all", "TRUE"), ("5", "recency <= 5")):
    _parts, _names = [], []
    for _kind, _edge in EDGE_CTES.items():
        cte(
            f"mx_{_kind}_{_label}",
            f"""SELECT session, aid_y AS aid, avg(wgt) AS mean_, min(wgt) AS min_, max(wgt) AS max_, median(wgt) AS median_, sum(wgt) AS sum_
              FROM obs_ranked o JOIN {_edge} e ON o.aid = e.aid_x WHERE {_cond} GROUP BY session, aid_y""",
        )
        for _stat in ("mean", "min", "max", "median", "sum"):
            _name = f"wgt_{_kind}_sum_last{_label}" if _stat == "sum" else f"wgt_{_kind}_{_stat}_{_label}"
            _names.append(_name)
            _parts.append(f"coalesce({_kind}.{_stat}_, 0) AS {_name}")
    _joins = " ".join(
        f"LEFT JOIN mx_{k}_{_label} {k} ON {k}.session = c.session AND {k}.aid = c.aid" for k in EDGE_CTES
    )
    cte(f"matrix_feats_{_label}", f"SELECT c.session, c.aid, {', '.join(_parts)} FROM cand_buys c {_joins}")
    MATRIX_COLUMNS[_label] = _names
cte(
    "matrix_feats",
    "SELECT a.session, a.aid, "
    + ", ".join(MATRIX_COLUMNS["all"] + MATRIX_COLUMNS["5"])
    + " FROM matrix_feats_all a JOIN matrix_feats_5 b ON a.session = b.session AND a.aid = b.aid",
)
query(
    "features_matrix", sql_round_all(MATRIX_COLUMNS["all"] + MATRIX_COLUMNS["5"], ["session", "aid"], "matrix_feats")
)(
    lambda s, d: round_all(
        matrix_features(s, d), ("session", "aid")
    )
)
query(
    "features_matrix_scaled",
    sql(
        "SELECT session, aid, "
        + ", ".join(f"round({c} * (7.0 / 9.0), 6) AS {c}" for c in MATRIX_COLUMNS["all"])
        + " FROM matrix_feats"
    ),
)(
    lambda s, d: round_all(
        mx.scale_columns(
            matrix_features(s, d).select(
                "session", "aid", *MATRIX_COLUMNS["all"]
            ),
            mx.TEST_PHASE_SCALE,
        ),
        ("session", "aid"),
    )
)
cte("obs_last", "SELECT session, aid AS aid_last FROM obs_ranked WHERE recency = 1")
cte(
    "matrix_last",
    "SELECT c.session, c.aid, "
    + ", ".join(f"CAST(trunc(coalesce({k}.wgt, 0)) AS BIGINT) AS cvm_weight_{k}_last1" for k in EDGE_CTES)
    + " FROM cand_buys c LEFT JOIN obs_last l ON c.session = l.session "
    + " ".join(f"LEFT JOIN {e} {k} ON {k}.aid_x = l.aid_last AND {k}.aid_y = c.aid" for k, e in EDGE_CTES.items()),
)
query("features_matrix_last", sql("SELECT * FROM matrix_last"))(
    lambda s, d: matrix_last(s, d)
)

# --- vectors -----------------------------------------------------------------------------------------------

DIM = range(VECTOR_DIMS)
query(
    "features_vector_item",
    sql("SELECT aid, " + ", ".join(f"svd_{i} AS svd_{i}_candidates" for i in DIM) + " FROM fx_item_vectors"),
)(lambda s, d: vec.features_vector_item(fx.fx_item_vectors(s, d)))
cte(
    "session_vectors",
    "SELECT o.session, "
    + ", ".join(
        [f"max(CASE WHEN recency = 1 THEN svd_{i} END) AS svd_{i}_last1" for i in DIM]
        + [f"avg(svd_{i}) FILTER (WHERE recency <= 5) AS svd_{i}_last5" for i in DIM]
        + [f"avg(svd_{i}) AS svd_{i}_all" for i in DIM]
    )
    + " FROM obs_ranked o JOIN fx_item_vectors v ON o.aid = v.aid GROUP BY o.session",
)
SESSION_VECTOR_COLUMNS = [f"svd_{i}_{v}" for v in ("last1", "last5", "all") for i in DIM]
query("features_vector_session", sql_round_all(SESSION_VECTOR_COLUMNS, ["session"], "session_vectors"))(
    lambda s, d: round_all(
        vec.features_vector_session(fx.fx_observed(s, d), fx.fx_item_vectors(s, d)), ("session",)
    )
)
for _v in ("last1", "last5", "all"):
    _diff = [f"v.svd_{i} - s.svd_{i}_{_v} AS svd_{i}_diff_candidates_{_v}" for i in DIM]
    _total = " + ".join(f"abs(v.svd_{i} - s.svd_{i}_{_v})" for i in DIM)
    cte(
        f"vector_pair_{_v}",
        f"""SELECT c.session, c.aid, {', '.join(_diff)}, {_total} AS svd_total_diff_candidates_{_v}
          FROM cand_buys c JOIN fx_item_vectors v ON c.aid = v.aid JOIN session_vectors s ON c.session = s.session""",
    )
    query(
        f"features_vector_pair_{_v}",
        sql_round_all(
            [f"svd_{i}_diff_candidates_{_v}" for i in DIM] + [f"svd_total_diff_candidates_{_v}"],
            ["session", "aid"],
            f"vector_pair_{_v}",
        ),
    )(
        lambda s, d, v=_v: round_all(
            vec.features_vector_pair(
                Inputs(s, d).candidates("buys"),
                vec.features_vector_item(fx.fx_item_vectors(s, d)),
                vec.features_vector_session(fx.fx_observed(s, d), fx.fx_item_vectors(s, d)),
                (v,),
            ),
            ("session", "aid"),
        )
    )
