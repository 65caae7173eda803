import random
from collections import defaultdict

import numpy as np

from basketweave.llm import neardup, shingles
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, words


def word_sets(text, n=5):
    w = (text or "").split()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_force(docs):
    """{row: (class, links)} over (id, text) rows, by all pairs of distinct sets."""
    sets = [word_sets(t) for _, t in docs]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x == y or both >= 0.8 * (len(x) + len(y) - both) > 0:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = i if least[find(k)] is None else min(i, least[find(k)])
    return sorted(((i, least[find(k)], links[k]) for k, (i, _) in enumerate(docs)), key=str)


def edited(text, share, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def check(spark, docs, **options):
    got = neardup.near_duplicates(make_docs(spark, docs), **options).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(docs)


def test_copies_edits_and_shared_passages(spark):
    passage = " ".join(words(60, 77))
    texts = [" ".join(words(40 + k, k, 5000)) for k in range(60)]
    texts += [f"{passage} {t}" for t in texts[:40]]
    texts += [edited(t, s, k) for k, t in enumerate(texts[:30]) for s in (0.01, 0.02, 0.03, 0.1)]
    texts += texts[:10] * 3 + ["", "one", "one", "two words", None, " "]
    random.Random(1).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_a_group_larger_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 16)
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", 32)
    base = " ".join(words(120, 5, 5000))
    texts = [edited(base, 0.01, k) for k in range(90)] + [" ".join(words(50, 100 + k, 5000)) for k in range(30)]
    check(spark, list(enumerate(texts)))


def test_many_copies_of_one_text(spark):
    base = " ".join(words(50, 3))
    check(spark, list(enumerate([base] * 200 + [edited(base, 0.02, 1)] * 50 + ["other text of five words"])))


def test_odd_rows_and_one_row_of_each_class(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = neardup.near_duplicates(docs)
    assert sorted((tuple(r) for r in got.select("doc_id", "class_id", "n_links").collect()), key=str) == brute_force(rows)
    left = neardup.keep_first_of_class(docs)
    texts = [r["text"] for r in left.collect()]
    assert left.columns == docs.columns and len({word_sets(t) for t in texts}) == len(texts) == len({word_sets(t) for _, t in rows})


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neardup.keep_first_of_class(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_reach_the_recall():
    """Sets right at the threshold meet in a bucket as often as promised."""
    r, met, runs = np.random.default_rng(4), 0, neardup.runs_needed(0.995, 0.8)
    for _ in range(300):
        both = r.integers(0, 1 << 63, 320, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, r.integers(0, 1 << 63, 40, dtype=np.uint64)))) for _ in range(2))
        deep = [set(neardup.chosen_nodes(x, runs)[1][-1]) for x in (a, b)]
        met += bool(deep[0] & deep[1])
    assert met >= 290


def test_shingles_depend_on_their_words_alone():
    long, short = "a b c d e f g", "b  c\nd e f"
    sets = shingles.shingle_sets([long, short, "", "a b", "a b", "b a"])
    assert set(sets[1]) <= set(sets[0]) and len(sets[0]) == 3 and len(sets[2]) == 0
    assert list(sets[3]) == list(sets[4]) != list(sets[5])
    assert shingles.set_key(sets[3]) == shingles.set_key(sets[4]) != shingles.set_key(sets[5])


def test_cells_of_two_blocks_give_one_edge_for_parts_that_meet():
    """The edges of a group of many blocks grow with its members, not with members times blocks."""
    size, blocks = 30, 6
    names = np.arange(size * blocks).reshape(blocks, size)
    sets = [np.arange(200, dtype=np.uint64).tobytes()] * 2 * size
    same = [neardup.sketch(np.arange(200, dtype=np.uint64))] * 2 * size
    found = {"sketches": [], "sets": []}
    for i in range(blocks):
        for j in range(i, blocks):
            own = np.repeat([i, j], size) if i != j else np.repeat(i, size)
            node, k = names[[i, j]].ravel() if i != j else names[i], len(own)
            found["sketches"] += neardup.like_sketches(0.8)(own, i, j, node, np.full(k, 200), same[:k])
            exact = neardup.exact_links(0.8)(own, i, j, node, np.ones(k, np.int64), sets[:k])
            found["sets"] += [(a, b) for a, b, links in exact if not links]
    for edges in found.values():
        assert len(edges) == blocks * (size - 1) + blocks * (blocks - 1) // 2
        reached = {0}
        for _ in range(blocks + 1):
            reached |= {x for e in edges if reached & set(e) for x in e}
        assert len(reached) == size * blocks
