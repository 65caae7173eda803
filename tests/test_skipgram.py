import numpy as np
import pytest
from pyspark.sql import functions as F

from basketweave.operators import skipgram as sg
from basketweave.operators.recency import with_positions
from basketweave.operators.vectors import overlapping_chunks

PLAIN = dict(sample=0, window=3, seed=5)


@pytest.mark.parametrize("length", [3, 7, 100])
def test_chunks_give_each_context_pair_once(events, length):
    log = events([(s, s * 100 + k, k // 2, 0) for s, n in ((1, 25), (2, 1), (3, 7)) for k in range(n)])
    chunks = overlapping_chunks(with_positions(log), ["aid"], length, 3).collect()
    found = []
    for row in chunks:
        for k in range(row["skip"], row["skip"] + row["core"]):
            near = row["items"][max(0, k - 3) : k + 4]
            found += [(row["items"][k]["aid"], x["aid"]) for x in near if x["position"] != row["items"][k]["position"]]
    wanted = [(s * 100 + a, s * 100 + b) for s, n in ((1, 25), (2, 1), (3, 7)) for a in range(n) for b in range(n) if 0 < abs(a - b) <= 3]
    assert sorted(found) == sorted(wanted)


def test_positions_keep_columns_of_any_name(events):
    log = events([(1, 5, 3, 0), (1, 6, 1, 0), (2, 7, 1, 0)])
    for name in ("place", "run", "offset", "n", "rest"):
        log = log.withColumn(name, F.col("aid") * 10)
    out = with_positions(log)
    assert out.columns == [*log.columns, "position", "session_length"]
    assert sorted((r["aid"], r["position"], r["session_length"]) for r in out.collect()) == [(5, 1, 2), (6, 0, 2), (7, 0, 1)]
    assert all(r[name] == r["aid"] * 10 for r in out.collect() for name in ("place", "run", "offset", "n", "rest"))


def test_pairs_do_not_depend_on_chunks_or_blocks(events, spark):
    log = events([(s, (s * 7 + k * k) % 50, k, 0) for s in range(20) for k in range(s)])

    def pairs(block_items, length):
        items, _, blocks = sg.item_blocks(log, block_items, 0)
        assert blocks == -(-items.count() // block_items)
        made = sg.context_pairs(log, items, 3, 5, length)
        a, b = (items.select("block", "place", "aid").toDF(x, y, z) for x, y, z in (("i", "center", "a"), ("j", "context", "b")))
        return sorted((r["a"], r["b"]) for r in made.join(a, ["i", "center"]).join(b, ["j", "context"]).collect())

    assert pairs(1000, 1000) == pairs(7, 5)


def test_packed_pairs_keep_every_pair(spark):
    pairs = spark.range(1000).select(
        (F.col("id") % 3).cast("int").alias("i"), (F.col("id") % 2).cast("int").alias("j"), F.col("id").cast("int").alias("center"),
        (F.col("id") + 1).cast("int").alias("context"), F.xxhash64("id").alias("mix"),
    )
    rows = sg.packed_pairs(pairs, 3, 40).collect()
    got = sorted((r["i"], r["j"], c, o) for r in rows for c, o in zip(r["centers"], r["contexts"], strict=True))
    assert got == sorted((k % 3, k % 2, k, k + 1) for k in range(1000))
    assert all(r["round"] == (r["j"] - r["i"]) % 3 and len(r["centers"]) < 90 for r in rows)


def test_batch_steps_follow_the_gradient():
    """With one pair per batch and no negatives the step is the logistic gradient of both vectors."""
    inner, outer = np.full((1, 2), 0.5, np.float32), np.array([[1.0, -0.5]], np.float32)
    w, v = inner[0].copy(), outer[0].copy()
    sg.learn_pairs(inner, outer, np.array([1]), np.array([0]), np.array([0]), 0.1, 0.1, 0, 1.0, np.random.default_rng(0))
    g = 0.1 * (1 - 1 / (1 + np.exp(-w @ v)))
    assert np.allclose(inner[0], w + g * v) and np.allclose(outer[0], v + g * w)


def test_repeated_rows_are_added():
    matrix = np.zeros((4, 2))
    sg.add_rows(matrix, np.array([2, 0, 2]), np.array([[1.0, 1], [2, 2], [3, 3]]))
    assert matrix.tolist() == [[2, 2], [0, 0], [4, 4], [0, 0]]


def clusters(events, hot=0):
    rng = np.random.default_rng(1)
    rows = [(s, int((s % 4) * 10 + rng.integers(10)), k, 0) for s in range(240) for k in range(12)]
    rows += [(1000, int(rng.integers(10)), k, 0) for k in range(hot)]
    return events(rows)


@pytest.mark.parametrize("block_items, part_pairs", [(1000, 10**6), (15, 700)])
def test_neighbours_share_the_planted_cluster(events, block_items, part_pairs):
    log = clusters(events, hot=1400)  # one session holds a third of the log
    rows = sg.train_skipgram(log, size=8, epochs=6, rate=0.2, block_items=block_items, part_pairs=part_pairs, sample=0.05).collect()
    assert len(rows) == 40
    aids = np.array([r["aid"] for r in rows])
    m = np.array([r["vector"] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T - 2 * np.eye(len(m))
    assert (aids[near.argmax(axis=1)] // 10 == aids // 10).mean() >= 0.9


def test_many_parts_add_up_alike(monkeypatch, events):
    log = clusters(events)
    options = dict(size=4, epochs=1, block_items=25, part_pairs=300)
    once = {r["aid"]: r["vector"] for r in sg.train_skipgram(log, **options).collect()}
    monkeypatch.setattr(sg, "MERGE", 3)
    again = {r["aid"]: r["vector"] for r in sg.train_skipgram(log, **options).collect()}
    assert once.keys() == again.keys() and all(np.allclose(once[a], again[a], atol=1e-6) for a in once)


def test_empty_log_null_items_and_single_events(events):
    assert sg.train_skipgram(events([]), size=4, epochs=1).count() == 0
    rows = sg.train_skipgram(events([(1, 7, 1, 0), (2, None, 1, 0)]), size=4, epochs=1).collect()
    assert [r["aid"] for r in rows] == [7] and len(rows[0]["vector"]) == 4


def test_batches_drawn_together_learn_as_one_by_one(monkeypatch):
    """each batch of 16 pairs drew its negatives and ordered its rows alone; many at once give the same vectors."""
    r, calls = np.random.default_rng(1), []
    counts, centers, contexts = r.integers(1, 100, 30), r.integers(0, 30, 5003), r.integers(0, 30, 5003)
    start = ((r.random((30, 8)) - 0.5) / 8).astype(np.float32)
    order_rows = sg.runs
    monkeypatch.setattr(sg, "runs", lambda rows: calls.append(rows.shape) or order_rows(rows))
    found = []
    for drawn in (1, 4096):
        monkeypatch.setattr(sg, "DRAWN", drawn)
        inner, outer = start.copy(), np.zeros((30, 8), np.float32)
        sg.learn_pairs(inner, outer, counts, centers, contexts, 0.2, 0.01, 5, 1.0, np.random.default_rng([3, 4]))
        found.append((inner, outer, len(calls)))
    assert (found[0][0] == found[1][0]).all() and (found[0][1] == found[1][1]).all()
    assert found[0][2] == 2 * 313 and found[1][2] - found[0][2] == 6
