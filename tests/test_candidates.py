import math
import random
from collections import Counter, defaultdict

import pytest

from basketweave.operators import candidates as cand
from basketweave.operators import recommend as rec
from tests.conftest import rows
from tests.test_covisit import WEIGHT, random_log


def position_weight(i, length, start):
    return 2 ** (start + (1 - start) * i / max(length - 1, 1)) - 1


def test_single_event_session(events, edges):
    none = edges([]).limit(0)
    df = events([(1, 10, 5, 1)])
    assert rows(cand.session_score_buys(df, none)) == [(1, 10, pytest.approx(6 * (2**0.5 - 1)))]
    assert rows(cand.session_score_clicks(df)) == [(1, 10, pytest.approx(6 * (2**0.1 - 1)), 1, 5, 0, 1, 0)]


def test_buy_scores_equal_brute_force(events, edges):
    log = random_log(11, sessions=5)
    links = [(x, y, 1) for x in range(9) for y in range(9) if x != y and (x * y) % 4 == 1]
    score, bonus = defaultdict(float), Counter()
    for s in {r[0] for r in log}:
        mine = sorted((ts, i, a, t) for i, (x, a, ts, t) in enumerate(log) if x == s)
        for p, (_, _, a, t) in enumerate(mine):
            score[s, a] += WEIGHT[t] * position_weight(p, len(mine), 0.5)
        for a in {a for _, _, a, t in mine if t in (1, 2)}:
            for x, y, _ in links:
                if x == a:
                    bonus[s, y] += 1
    expected = sorted((s, a, v + 0.1 * bonus[s, a]) for (s, a), v in score.items())
    got = rows(cand.session_score_buys(events(log), edges(links)))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert all(math.isclose(g[2], e[2], rel_tol=1e-9) for g, e in zip(got, expected))


def brute_additional(log, links_all, links_buys, top, n, first):
    out = []
    for s in {r[0] for r in log}:
        own = {a for x, a, _, _ in log if x == s}
        bought = {a for x, a, _, t in log if x == s and t in (1, 2)}
        if len(own) >= n:
            continue
        hits = Counter(y for x, y, _ in links_all if x in own) + Counter(y for x, y, _ in links_buys if x in bought)
        added = sorted(hits.items(), key=lambda h: (-h[1], h[0]))[:n]
        taken = {a for a, _ in added} | own
        fill = [a for a in top if a not in taken][: n - len(added)]
        out += [(s, a, w) for a, w in added] + [(s, a, -(i + first)) for i, a in enumerate(fill)]
    return sorted(out)


@pytest.mark.parametrize("n", [4, 6, 9])
def test_additional_candidates_equal_brute_force(events, edges, n):
    rng = random.Random(n)
    log = random_log(n, sessions=20, items=12, most=9)
    links = [(rng.randrange(12), y, 1) for y in range(12)][:5]
    buys = [(rng.randrange(12), y, 1) for y in range(12)][6:9]
    counts = {t: Counter(a for _, a, _, x in log if x == t) for t in (0, 2)}
    ranked = {t: [a for a, _ in sorted(c.items(), key=lambda h: (-h[1], h[0]))] for t, c in counts.items()}
    df = events(log)
    assert rows(cand.additional_clicks(df, edges(links), n)) == brute_additional(log, links, [], ranked[0][:n], n, 1)
    assert rows(cand.additional_buys(df, edges(links), edges(buys), n)) == brute_additional(
        log, links, buys, ranked[2][: int(1.5 * n)], n, 0
    )


def test_merge_order_puts_missing_scores_last(spark):
    own = spark.createDataFrame([(1, 10, 0.5), (1, 11, 2.0)], "session BIGINT, aid INT, session_score DOUBLE")
    more = spark.createDataFrame([(1, 10, 9), (1, 12, 3), (1, 13, -1), (2, 14, 1)], "session BIGINT, aid INT, wgt BIGINT")
    merged = cand.merge_candidates(own, more, 3)
    assert rows(merged, "session", "candidate_pos", "aid") == [(1, 0, 11), (1, 1, 10), (1, 2, 12), (2, 0, 14)]


def test_labels_may_be_empty_or_missing(spark):
    candidates = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "session BIGINT, aid INT")
    labels = spark.createDataFrame(
        [(1, "orders", [11, 11]), (1, "carts", [10]), (2, "orders", [])],
        "session BIGINT, type STRING, ground_truth ARRAY<INT>",
    )
    assert rows(cand.label_candidates(candidates, 2, labels), "session", "aid", "target") == [(1, 10, 0), (1, 11, 1), (2, 10, 0)]
    assert {r[0] for r in rows(cand.label_candidates(candidates, 2), "target")} == {0}


def test_recommendation_list_of_the_worked_example(spark):
    scores = spark.createDataFrame(
        [
            (11098528, 11830, 3.338930),
            (11098528, 1157882, -0.623595),
            (11098528, 571762, -0.369184),
            (11098528, 588923, -0.337537),
            (11098528, 231487, -0.851709),
        ],
        "session BIGINT, aid INT, score DOUBLE",
    )
    assert rows(rec.make_recommendations(scores, 2)) == [("11098528_orders", "11830 588923 571762 1157882 231487")]


def test_recall_counts_sessions_without_recommendations_and_caps_the_truth(spark):
    recs = spark.createDataFrame(
        [("1_orders", " ".join(map(str, range(30)))), ("2_carts", "5"), ("4_orders", "7 8")],
        "session_type STRING, labels STRING",
    )
    labels = spark.createDataFrame(
        [(1, "orders", list(range(25))), (3, "orders", [1, 2]), (2, "carts", [5, 6]), (4, "orders", [])],
        "session BIGINT, type STRING, ground_truth ARRAY<INT>",
    )
    assert rows(rec.recall_by_type(recs, labels)) == [("carts", 1, 2, 0.5), ("orders", 20, 22, 20 / 22)]
    score = rec.weighted_score(recs, labels).first()
    assert score["recall_clicks"] == 0.0
    assert score["score"] == pytest.approx(0.3 * 0.5 + 0.6 * 20 / 22)


def test_submission_text_is_cut_and_sorted(spark):
    make = lambda n: spark.createDataFrame([(f"2_{n}", "1234 5678"), (f"1_{n}", "9")], "session_type STRING, labels STRING")
    out = rec.concat_submissions(make("clicks"), make("carts"), make("orders"), limit=6).collect()
    assert [tuple(r) for r in out] == [
        ("1_carts", "9"), ("1_clicks", "9"), ("1_orders", "9"),
        ("2_carts", "1234"), ("2_clicks", "1234 5678"), ("2_orders", "1234"),
    ]


def test_fillers_reach_sessions_with_many_items(events):
    """A session that holds as many items as are asked for still gets the top items it lacks."""
    log = [(1, a, 10 + a, 0) for a in (1, 2, 3)] + [(2, a, 20 + a, 0) for a in (1, 4)] + [(3, 9, 30, 2)]
    got = rows(cand.top_fillers(events(log), 0, 3))  # top clicks: 1 (twice), then 2, 3
    assert got == [(2, 2, -1), (2, 3, -2), (3, 1, -1), (3, 2, -2), (3, 3, -3)]
    assert rows(cand.top_fillers(events(log + [(4, 9, 40, 0), (5, 9, 40, 0), (6, 9, 40, 0)]), 0, 3))[0] == (1, 9, -1)
