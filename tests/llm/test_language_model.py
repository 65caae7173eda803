import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketweave.llm import language_model as lm
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose

END = ""
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [END]


def scores(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def gibbs(texts, d, s, root_d, root_s, sweeps=300, seed=0):
    """Customers taken out and seated again one by one; gives the averaged P(w | u) as a function."""
    r = random.Random(seed)
    customers = [(u, w) for t in texts for u, w in zip([END, *tokens(t)], tokens(t))]
    tables = defaultdict(lambda: defaultdict(list))  # context, word: sizes of tables
    n, total, root, all_tables = Counter(), Counter(), Counter(), 0

    def base(w):
        return max(0.0, root[w] - root_d) / (root_s + all_tables)

    def change(u, w, k, by):
        nonlocal all_tables
        own = tables[u][w]
        if k == len(own):
            own.append(0)
            total[u], root[w], all_tables = total[u] + 1, root[w] + 1, all_tables + 1
        own[k] += by
        n[u] += by
        if not own[k]:
            own.pop(k)
            total[u], root[w], all_tables = total[u] - 1, root[w] - 1, all_tables - 1

    def seat(u, w):
        own = tables[u][w]
        weights = [x - d for x in own] + [(s + d * total[u]) * base(w) if own else 1.0]
        change(u, w, r.choices(range(len(weights)), weights)[0], 1)

    for u, w in customers:
        seat(u, w)
    sums = Counter()
    kept = 0
    for sweep in range(sweeps):
        for u, w in customers:
            change(u, w, r.choices(range(len(tables[u][w])), tables[u][w])[0], -1)
            seat(u, w)
        if sweep >= sweeps // 3:
            kept += 1
            unknown = (root_s + root_d * len(+root)) / (root_s + all_tables)
            words = sorted({x[1] for x in customers}) + ["?"]  # the text end is among them
            for u, w in product(words, words):
                own = tables[u][w] if w in tables.get(u, ()) else []
                parent = unknown if w == "?" else base(w)
                sums[u, w] += (sum(own) - d * len(own)) / (s + n[u]) + (s + d * total[u]) / (s + n[u]) * parent
    return lambda u, w: sums[u, w] / kept


def test_arrays_come_back():
    r = np.random.default_rng(1)
    arrays = [r.integers(-(2**62), 2**62, 50), np.zeros(0, np.int64), np.arange(300), np.array([255]), np.array([256, 0]), np.array([-1])]
    assert all((a == b).all() for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True))


def partitions(n):
    """Sizes of the blocks of every way to part n customers."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        yield p + [1]
        for k in range(len(p)):
            yield p[:k] + [p[k] + 1] + p[k + 1 :]


@pytest.mark.parametrize("d, s, others, words, tables", [(0.7, 1.0, 3, 20, 100), (0.3, 0.5, 0, 1, 40), (0.9, 2.0, 40, 0, 50)])
def test_tables_follow_their_conditional(d, s, others, words, tables):
    own, want = lm.Discounts(d, s, 0.6, 1.5), np.zeros(8)
    for sizes in partitions(7):
        weight = math.prod(math.prod(k - d for k in range(1, n)) for n in sizes)
        weight *= math.prod((s + d * (others + k)) * (words - 0.6 + k) / (1.5 + tables + k) for k in range(1, len(sizes)))
        want[len(sizes)] += weight
    want /= want.sum()
    n, full = 40_000, lambda x: np.full(40_000, x)
    t = lm.draw_tables(full(7), full(others), full(words), full(tables), own, lm.log_seatings(d), np.random.default_rng(2))
    assert np.abs(np.bincount(t, minlength=8) / n - want).max() < 0.01


@pytest.mark.parametrize("d, others, words, tables, c", [(0.6, 200, 5000, 100_000, 180), (0.8, 5000, 100, 10_000, 180), (0.8, 50, 0, 1000, 180), (0.7, 20, 300, 1000, 400), (0.8, 20, 1, 100, 1000)])
def test_many_customers_follow_it_nearly(d, others, words, tables, c):
    k, own = np.arange(1, c), lm.Discounts(d, 1.0, 0.6, 1.5)
    log = lm.log_seatings(d, c)[c, 1:].copy()
    log[1:] += np.cumsum(np.log((1.0 + d * (others + k)) * (words - 0.6 + k) / (1.5 + tables + k)))
    chance = np.exp(log - log.max())
    mean = (chance / chance.sum() * np.arange(1, c + 1)).sum()
    full = lambda x: np.full(4000, x)
    t = lm.draw_tables(full(c), full(others), full(words), full(tables), own, lm.log_seatings(d), np.random.default_rng(3))
    assert abs(t.mean() / mean - 1) < 0.06


def small_corpus():
    r = random.Random(4)
    pool = ["ab", "cd", "ef", "gh", "ij", "kl"]
    follow = {w: r.choices(pool, k=3) for w in pool}
    texts = []
    for _ in range(40):
        w, own = r.choice(pool), []
        for _ in range(r.randint(1, 9)):
            own.append(w)
            w = r.choice(follow[w])
        texts.append(" ".join(own))
    return texts


def test_scores_match_one_by_one_gibbs_sampling(spark):
    texts = small_corpus()
    asked = ["ab cd", "zz", "ab zz ef", "", "kl kl kl gh"]
    docs = make_docs(spark, texts + [(1000 + k, t) for k, t in enumerate(asked)])
    params = lm.Params(rounds=3, sweeps=60, samples=40)
    found = scores(lm.score_texts(docs, F.col("doc_id") >= 1000, params))
    # The discounts as the operator sets them, from counts of one and two.
    pairs = Counter((u, w) for t in texts for u, w in zip([END, *tokens(t)], tokens(t)))
    ones = Counter(pairs.values())
    root = Counter(Counter(w for _, w in pairs).values())
    d = lm._discount(ones[1], ones[2])
    predict = gibbs(texts, d, params.strength, lm._discount(root[1], root[2]), params.root_strength)
    known = {w for _, w in pairs}
    for k, t in enumerate(asked + texts[:10]):
        own = [w if w in known else "?" for w in tokens(t)]
        want = sum(math.log10(predict(u, w)) for u, w in zip([END, *own], own))
        got = found[1000 + k if k < len(asked) else k - len(asked)]["score"]
        assert abs(got - want) < 0.02 * len(own), (t, got, want)


def base_scores(texts, held):
    c = Counter(w for t, h in zip(texts, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in texts]


@pytest.mark.parametrize("small", [{}, {"block_bytes": 200, "bucket_tokens": 60, "bucket_words": 4, "split": 5}])
def test_base_scores_and_counts(spark, small):
    texts = small_corpus() + [prose(40, k) for k in range(20)] + [None, "", "A  a\x0b\x0c\n\x1cb", "É é", "x\xa0y"]
    held = [k % 4 == 0 for k in range(len(texts))]
    docs = make_docs(spark, texts).repartition(3)
    found = scores(lm.score_texts(docs, F.col("doc_id") % 4 == 0, **small))
    n, want = base_scores(texts, held)
    for k, (size, known, base) in enumerate(want):
        r = found[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], size, known, n)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base))
        assert r["score"] < 0 and abs(r["perplexity"] - 10 ** (-r["score"] / size)) < 1e-6 * r["perplexity"]


def test_dealing_the_work_does_not_change_the_model(spark):
    texts = small_corpus() * 3
    docs, held = make_docs(spark, texts).repartition(3), F.col("doc_id") % 5 == 0
    params = lm.Params(rounds=3, sweeps=30, samples=20)
    whole = scores(lm.score_texts(docs, held, params))
    dealt = scores(lm.score_texts(docs, held, params, block_bytes=100, bucket_tokens=100, bucket_words=1, split=10))
    assert max(abs(whole[k]["score"] - dealt[k]["score"]) / whole[k]["n_tokens"] for k in whole) < 0.02


def test_held_out_texts_are_predicted_better_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = lm.score_texts(docs, lm.held_out_tenth()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.8 * found[1]


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark).withColumnRenamed("n", "block").withColumnRenamed("part", "held")
    found = lm.score_texts(docs, lm.held_out_tenth()).collect()
    assert len(found) == docs.count() and all(math.isfinite(r["score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), F.lit(False)).collect() == []
    untrained = lm.score_texts(make_docs(spark, ["a b", None]), F.lit(True)).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in untrained] == [(0, 0, 0.0, 0.0)] * 2


@pytest.mark.parametrize("text", ["a " * 400_000, "b" * 1_000_000, "x y " * 200_000 + "z"])
def test_very_long_texts(spark, text):
    found = scores(lm.score_texts(make_docs(spark, [text, "a b", prose(20)]), F.lit(False)))
    assert found[0]["n_tokens"] == len(tokens(text)) and math.isfinite(found[0]["score"])
