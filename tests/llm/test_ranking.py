import math
import random
import re
from collections import Counter

import pytest

from basketweave.llm import ranking
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, top=10):
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in cut(text) if t in b)
            if s > 0:
                scored.append((-s, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def make_items(spark, items):
    return spark.createDataFrame(items, "item_id BIGINT, text STRING")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_terms_follow_the_pattern():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("aZ09 @[`{/:\x00\x7f\x80\x85\xa0éİ日\U0001f600\n-", k=r.randint(0, 30)))
        assert [t.decode() for t in ranking.terms(text)] == cut(text)
    assert ranking.terms(None) == []


def test_scores_match_brute_force(spark, monkeypatch):
    r = random.Random(2)
    pool = [(i, prose(r.randint(1, 80), i)) for i in range(120)]
    pool += [(200 + i, pool[3][1]) for i in range(15)] + [(300, None), (301, " ... "), (302, prose(20_000, 5)), (303, "Ünï " + pool[0][1])]
    items = [(k, " ".join(words(r.randint(1, 30), 1000 + k, 120) * (1 + k % 2))) for k in range(12)] + [(12, pool[3][1]), (13, None), (14, "unheard"), (15, "ünï ÜNÏ Ünï")]
    docs = make_docs(spark, pool).repartition(5)
    want = brute_force(pool, items)
    assert got(ranking.rank_documents(docs, make_items(spark, items))) == want
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 5)  # several scans give the same
    assert got(ranking.rank_documents(docs, make_items(spark, items), together=7)) == want
    assert got(ranking.rank_documents(docs, make_items(spark, items), top=3)) == brute_force(pool, items, 3)


def test_shared_sums_are_whole_and_save_work():
    r = random.Random(3)
    groups = [r.sample(range(100), 12) for _ in range(4)]
    items = [{t: 1 + t % 2 for t in {*groups[k % 4], *groups[(k + 1) % 4], 200 + k}} for k in range(40)]
    plan = ranking.share(items)

    def leaves(k):
        return [plan.leaf_terms[k]] if k < plan.leaves else [x for j in plan.joins[k - plan.leaves] for x in leaves(j)]

    for item, operands in zip(items, plan.items):
        found = [x for k in operands for x in leaves(k)]
        assert sorted(found) == sorted(item.items())
    assert plan.additions() < sum(len(x) - 1 for x in items) / 4


def test_long_items_are_planned():
    items = [{t: 1 for t in range(3000)}, {t: 1 for t in range(1000, 4000)}]
    plan = ranking.share(items)
    assert plan.joins and all(plan.items)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark).withColumnRenamed("part", "item_id")
    items = make_items(spark, [(1, "same text twice"), (1, "same text twice"), (None, "no id here"), (2, ""), (3, "text"), (3, "x")])
    found = got(ranking.rank_documents(docs, items).na.fill(-1))
    by_item = {k: [r for r in found if r[0] == k] for k in (-1, 1, 2, 3)}
    assert [r[2] for r in by_item[-1]] == [-1, 7]
    assert [r[2] for r in by_item[1]][:3] == [5, 5, 6] and [r[1] for r in by_item[1]] == list(range(1, len(by_item[1]) + 1))
    assert by_item[2] == [] and {r[2] for r in by_item[3]} == {5, 6, 7}
    empty = spark.createDataFrame([], SCHEMA)
    assert got(ranking.rank_documents(empty, items)) == []
    assert got(ranking.rank_documents(docs, make_items(spark, []))) == []


@pytest.mark.parametrize("text", ["a " * 1_000_000, "b" * 1_000_000, "!" * 1_000_000, "12 " * 100_000])
def test_very_long_texts(spark, text):
    docs = [(1, text), (2, "a b 12 c")]
    items = [(1, "a 12"), (2, "c")]
    assert got(ranking.rank_documents(make_docs(spark, docs), make_items(spark, items))) == brute_force(docs, items)
