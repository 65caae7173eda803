import random
from collections import defaultdict

import pytest

from basketweave.functions.events import DAY
from basketweave.operators import covisit as cv
from basketweave.operators.recency import last_event, latest_events, with_positions
from tests.conftest import rows

WEIGHT = {0: 1, 1: 6, 2: 3}


def random_log(seed, sessions=12, items=9, most=45):
    rng = random.Random(seed)
    out = []
    for s in range(sessions):
        for _ in range(rng.randint(1, most)):
            out.append((s, rng.randrange(items), rng.randrange(0, 4 * DAY, DAY // 6), rng.choice([0, 0, 0, 1, 2])))
    return out


def brute_edges(log, kind, k, window, recent=30, t0=0, t1=4 * DAY):
    """Straight reading of the definition, one session at a time."""
    sessions = defaultdict(list)
    for i, (s, a, ts, t) in enumerate(log):
        if kind != "buy2buy" or t in (1, 2):
            sessions[s].append((ts, i, a, t))
    weight = defaultdict(lambda: [0, 0])
    for seen in sessions.values():
        newest = sorted(seen, reverse=True)[:recent]
        keys = set()
        for tx, _, ax, _ in newest:
            for ty, _, ay, yt in newest:
                if ax != ay and abs(tx - ty) < window:
                    keys.add((ax, ay, tx if kind == "clicks" else yt))
        for ax, ay, extra in keys:
            weight[ax, ay][0] += WEIGHT[extra] if kind == "buys" else 1
            weight[ax, ay][1] += extra - t0 if kind == "clicks" else 0
    total = {
        p: float(n) + 3.0 * float(sec) / float(t1 - t0) if kind == "clicks" else n for p, (n, sec) in weight.items()
    }
    out = []
    for ax in {p[0] for p in total}:
        best = sorted(((w, p[1]) for p, w in total.items() if p[0] == ax), key=lambda x: (-x[0], x[1]))[:k]
        out += [(ax, ay, w) for w, ay in best]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_edges_equal_brute_force(events, seed):
    log = random_log(seed)
    df = events(log)
    assert rows(cv.covisit_buy2buy(df, 2 * DAY, k=4)) == brute_edges(log, "buy2buy", 4, 2 * DAY)
    assert rows(cv.covisit_type_weighted(df, k=4)) == brute_edges(log, "buys", 4, DAY)
    assert rows(cv.covisit_time_weighted(df, 0, 4 * DAY, k=4)) == brute_edges(log, "clicks", 4, DAY)


def test_window_edge_is_strict_and_an_item_has_no_edge_to_itself(events):
    df = events([(1, 10, 0, 0), (1, 11, DAY, 0), (1, 10, DAY - 1, 0)])
    assert rows(cv.session_pairs(df, DAY), "aid_x", "aid_y", "ts_x") == [(10, 11, DAY - 1), (11, 10, DAY)]


def test_parts_of_sessions_merge_exactly(events):
    df = events(random_log(7))
    whole = rows(cv.top_edges(cv.type_weights(df), 3))
    parts = [cv.type_weights(df.where(f"session % 3 = {i}")) for i in range(3)]
    assert rows(cv.top_edges(cv.merge_edges(*parts), 3)) == whole


def test_ties_are_broken_by_event_id(events):
    df = events([(1, 5, 100, 0), (1, 6, 100, 1), (1, 7, 50, 2)])
    assert rows(last_event(df)) == [(1, 6, 1)]
    assert rows(latest_events(df, 2), "aid", "recency") == [(5, 2), (6, 1)]
    assert rows(with_positions(df), "aid", "position", "session_length") == [(5, 1, 3), (6, 2, 3), (7, 0, 3)]


@pytest.mark.parametrize("partitions", ["1", "3", "64"])
def test_positions_do_not_depend_on_the_split(events, conf, partitions):
    conf(spark__sql__shuffle__partitions=partitions)
    log = random_log(3, sessions=6)
    expected = []
    for s in {r[0] for r in log}:
        mine = sorted((ts, i) for i, (x, _, ts, _) in enumerate(log) if x == s)
        expected += [(i, p, len(mine)) for p, (_, i) in enumerate(mine)]
    got = rows(with_positions(events(log)), "event_id", "position", "session_length")
    assert got == sorted(expected)
