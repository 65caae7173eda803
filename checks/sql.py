"""The same views and operators as common table expressions for DuckDB."""

from __future__ import annotations

import re

from checks.views import K_EDGES, N_ADDITIONAL, N_CANDIDATES, T0, T1, T2, VECTOR_DIMS

DAY = 86_400
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(final: str) -> str:
    """``final`` with the expressions it needs in front, in order of definition."""
    needed: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    parts = [f"{n} AS ({b})" for n, b in CTES.items() if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


cte("fx_events", r"""
  SELECT user_id AS session, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS aid,
         epoch_us(ts) // 1000000 AS ts,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS type, event_id
  FROM events WHERE event_type <> 'error'""")
cte("fx_history", f"SELECT * FROM fx_events WHERE ts < {T1}")
cte("fx_observed", f"SELECT * FROM fx_events WHERE ts >= {T1} AND ts < {T2}")
cte("fx_known", f"SELECT * FROM fx_events WHERE ts < {T2}")
cte("fx_later", f"SELECT * FROM fx_events WHERE ts >= {T2} AND session IN (SELECT session FROM fx_observed)")
cte("fx_labels", """
  SELECT session, 'clicks' AS type, [arg_min(aid, (ts, event_id))] AS ground_truth FROM fx_later WHERE type = 0 GROUP BY session
  UNION ALL
  SELECT session, CASE type WHEN 1 THEN 'carts' ELSE 'orders' END AS type, list_sort(list(DISTINCT aid)) AS ground_truth
  FROM fx_later WHERE type > 0 GROUP BY session, type""")
cte("fx_baskets", """
  SELECT o_custkey AS session, l_partkey AS aid, epoch_us(o_orderdate) // 1000000 AS ts,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS type,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS event_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("fx_item_vectors", "SELECT vec_id AS aid, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS svd_{i}" for i in range(VECTOR_DIMS)) + " FROM embeddings")


def recent_of(src: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS recency
      FROM {src}) WHERE recency <= {n}"""


def pairs_of(src: str, window: int) -> str:
    return f"""SELECT a.session, a.aid AS aid_x, b.aid AS aid_y, a.ts AS ts_x, b.type AS type_y
      FROM {src} a JOIN {src} b ON a.session = b.session AND a.aid <> b.aid AND abs(a.ts - b.ts) < {window}"""


def top_of(src: str, k: int) -> str:
    return f"""SELECT aid_x, aid_y, wgt FROM (SELECT *, row_number() OVER (PARTITION BY aid_x ORDER BY wgt DESC, aid_y) AS n
      FROM {src}) WHERE n <= {k}"""


def define_edges(prefix: str, src: str, t0: int, t1: int, k: int) -> None:
    """``<prefix>_b2b``, ``<prefix>_typ`` and ``<prefix>_clk`` with their uncut weights ``_w``."""
    p = prefix
    cte(f"{p}_buys", f"SELECT * FROM {src} WHERE type IN (1, 2)")
    cte(f"{p}_buys30", recent_of(f"{p}_buys", 30))
    cte(f"{p}_all30", recent_of(src, 30))
    cte(f"{p}_b2b_pairs", pairs_of(f"{p}_buys30", 14 * DAY))
    cte(f"{p}_day_pairs", pairs_of(f"{p}_all30", DAY))
    cte(f"{p}_b2b_w", f"""SELECT aid_x, aid_y, count(*) AS wgt
      FROM (SELECT DISTINCT session, aid_x, aid_y, type_y FROM {p}_b2b_pairs) GROUP BY aid_x, aid_y""")
    cte(f"{p}_typ_w", f"""SELECT aid_x, aid_y, CAST(sum(CASE type_y WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 3 END) AS BIGINT) AS wgt
      FROM (SELECT DISTINCT session, aid_x, aid_y, type_y FROM {p}_day_pairs) GROUP BY aid_x, aid_y""")
    cte(f"{p}_clk_w", f"""SELECT aid_x, aid_y,
        CAST(count(*) AS DOUBLE) + 3.0 * CAST(sum(ts_x - {t0}) AS DOUBLE) / CAST({t1 - t0} AS DOUBLE) AS wgt
      FROM (SELECT DISTINCT session, aid_x, aid_y, ts_x FROM {p}_day_pairs) GROUP BY aid_x, aid_y""")
    for kind in ("b2b", "typ", "clk"):
        cte(f"{p}_{kind}", top_of(f"{p}_{kind}_w", k))


define_edges("ev", "fx_known", T0, T2, K_EDGES)

cte("pos", """SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS position,
    count(*) OVER (PARTITION BY session) AS session_length FROM fx_observed""")


def weight(start: float) -> str:
    return f"(pow(2.0, {start} + {1.0 - start} * position / greatest(session_length - 1, 1)) - 1.0)"


TYPE_W = "(CASE type WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 3 END)"
cte("ev_bonus", """SELECT session, aid_y AS aid, count(*) AS hits
  FROM (SELECT DISTINCT session, aid FROM fx_observed WHERE type IN (1, 2)) b JOIN ev_b2b e ON b.aid = e.aid_x GROUP BY session, aid_y""")
cte("sc_buys", f"""SELECT s.session, s.aid, score + 0.1 * coalesce(hits, 0) AS session_score
  FROM (SELECT session, aid, sum({TYPE_W} * {weight(0.5)}) AS score FROM pos GROUP BY session, aid) s
  LEFT JOIN ev_bonus b ON s.session = b.session AND s.aid = b.aid""")
cte("sc_clicks_all", f"""SELECT session, aid, sum({TYPE_W} * {weight(0.1)}) AS session_score,
    max(session_length) AS session_length, max(ts) AS last_event_ts,
    max(CASE WHEN type = 0 THEN 1 ELSE 0 END) AS exists_clicks,
    max(CASE WHEN type = 1 THEN 1 ELSE 0 END) AS exists_carts,
    max(CASE WHEN type = 2 THEN 1 ELSE 0 END) AS exists_orders FROM pos GROUP BY session, aid""")


def newest_of(n: int) -> str:
    return f"""SELECT session, aid, session_score, session_length, last_event_ts, exists_clicks, exists_carts, exists_orders
      FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY last_event_ts DESC, aid) AS n FROM sc_clicks_all) WHERE n <= {n}"""


cte("sc_clicks", newest_of(50))
cte("top_clicks", """SELECT aid, row_number() OVER (ORDER BY count(*) DESC, aid) AS rank FROM fx_observed WHERE type = 0 GROUP BY aid""")
cte("top_orders", """SELECT aid, row_number() OVER (ORDER BY count(*) DESC, aid) AS rank FROM fx_observed WHERE type = 2 GROUP BY aid""")


def define_additional(name: str, n: int, edges_clicks: str, edges_type: str, edges_b2b: str) -> None:
    """``<name>_clicks`` and ``<name>_buys``."""
    p = name
    cte(f"{p}_own", f"""SELECT session, aid, max(CASE WHEN type IN (1, 2) THEN 1 ELSE 0 END) AS bought FROM fx_observed
      WHERE session IN (SELECT session FROM fx_observed GROUP BY session HAVING count(DISTINCT aid) < {n}) GROUP BY session, aid""")
    cte(f"{p}_hits_clicks", f"SELECT session, aid_y FROM {p}_own JOIN {edges_clicks} ON aid = aid_x")
    cte(f"{p}_hits_buys", f"""SELECT session, aid_y FROM {p}_own JOIN {edges_type} ON aid = aid_x
      UNION ALL SELECT session, aid_y FROM {p}_own JOIN {edges_b2b} ON aid = aid_x WHERE bought = 1""")
    for kind, top, limit, first in (("clicks", "top_clicks", n, 1), ("buys", "top_orders", int(1.5 * n), 0)):
        cte(f"{p}_added_{kind}", f"""SELECT session, aid_y AS aid, wgt FROM (
            SELECT session, aid_y, count(*) AS wgt,
              row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, aid_y) AS k FROM {p}_hits_{kind} GROUP BY session, aid_y)
          WHERE k <= {n}""")
        cte(f"{p}_missing_{kind}", f"""SELECT s.session, {n} - count(a.aid) AS missing
          FROM (SELECT DISTINCT session FROM {p}_own) s LEFT JOIN {p}_added_{kind} a ON s.session = a.session GROUP BY s.session""")
        cte(f"{p}_fill_{kind}", f"""SELECT session, aid, k, missing FROM (
            SELECT m.session, t.aid, m.missing, row_number() OVER (PARTITION BY m.session ORDER BY t.rank) - 1 AS k
            FROM {p}_missing_{kind} m CROSS JOIN (SELECT * FROM {top} WHERE rank <= {limit}) t
            WHERE NOT EXISTS (SELECT 1 FROM {p}_own o WHERE o.session = m.session AND o.aid = t.aid)
              AND NOT EXISTS (SELECT 1 FROM {p}_added_{kind} a WHERE a.session = m.session AND a.aid = t.aid))
          WHERE k < missing""")
        cte(f"{p}_{kind}", f"""SELECT session, aid, wgt FROM {p}_added_{kind}
          UNION ALL SELECT session, aid, -(k + {first}) AS wgt FROM {p}_fill_{kind}""")


define_additional("add", N_ADDITIONAL, "ev_clk", "ev_typ", "ev_b2b")
for _kind in ("clk", "typ", "b2b"):
    cte(f"ev2_{_kind}", top_of(f"ev_{_kind}_w", 2))
define_additional("fil", 8, "ev2_clk", "ev2_typ", "ev2_b2b")


def merged_of(session_cands: str, additional: str, n: int) -> str:
    return f"""SELECT session, aid, session_score, wgt, candidate_pos FROM (
      SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(session_score, 9) DESC NULLS LAST, wgt DESC NULLS LAST, aid) - 1 AS candidate_pos
      FROM (SELECT session, aid, session_score, CAST(NULL AS BIGINT) AS wgt FROM {session_cands}
        UNION ALL SELECT session, aid, NULL, wgt FROM {additional} a
          WHERE NOT EXISTS (SELECT 1 FROM {session_cands} s WHERE s.session = a.session AND s.aid = a.aid)))
    WHERE candidate_pos < {n}"""


cte("cand_buys", merged_of("sc_buys", "add_buys", N_CANDIDATES))
cte("cand_clicks", merged_of("sc_clicks", "add_clicks", N_CANDIDATES))
cte("truth", """SELECT DISTINCT session, CASE type WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END AS type, aid, 1 AS target
  FROM (SELECT session, type, unnest(ground_truth) AS aid FROM fx_labels)""")
cte("labelled", """SELECT c.session, c.aid, c.candidate_pos, 2 AS type, coalesce(t.target, 0) AS target
  FROM cand_buys c LEFT JOIN truth t ON c.session = t.session AND c.aid = t.aid AND t.type = 2""")

# Recommendation lists straight from the merged candidate order, which needs no model.
for _name, _src in (("clicks", "cand_clicks"), ("carts", "cand_buys"), ("orders", "cand_buys")):
    cte(f"rec_{_name}", f"""SELECT session || '_{_name}' AS session_type,
        string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY candidate_pos) AS labels FROM {_src} WHERE candidate_pos < 40 GROUP BY session""")
cte("recs", "SELECT * FROM rec_clicks UNION ALL SELECT * FROM rec_carts UNION ALL SELECT * FROM rec_orders")
