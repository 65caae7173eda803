import random

import numpy as np

from basketweave.llm import decontaminate
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose, words

ITEMS = "item_id BIGINT, text STRING, block INT"


def bench(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], ITEMS)


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def paraphrase(text, seed):
    """One word in six replaced, outside the last sentence."""
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w) - 8), len(w) // 6):
        w[i] = f"other{i}"
    return " ".join(w)


def test_finds_passages_and_paraphrases_and_leaves_others(spark):
    items = [" ".join(words(15 + 5 * k, 1000 + k, 3000)) + ". " + " ".join(words(5, 2000 + k, 3000)) + "." for k in range(10)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for form in (item, item.upper().replace(" ", "\n"), paraphrase(item, k)):
            before, after = prose(37 + 3 * k, len(texts)), prose(51, 500 + len(texts))
            want.add((len(texts), k))
            texts.append(f"{before} {form} {after}")
    texts += [prose(200, 900 + k) for k in range(60)]
    texts += [" ".join(items[k].split()[:6]) + " " + prose(80, 700 + k) for k in range(5)]  # a few words in common
    docs, benchmark = make_docs(spark, texts), bench(spark, items)
    assert pairs(decontaminate.contaminated(docs, benchmark)) == want
    left = decontaminate.without_benchmark(docs, benchmark)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want} and left.columns == docs.columns


def test_verbatim_items_of_any_length_at_any_offset(spark):
    lengths = (1, 3, 5, 8, 10, 12, 14, 60, 100, 200, 400, 1000)
    # Parts of a long item are unlike each other.
    items = [" ".join(f"{w}q{k}p{at // 40}" for at, w in enumerate(words(n, 1000 + k))) for k, n in enumerate(lengths)]
    texts = [f"{prose(40 + offset, 31 * k + offset)} {item} {prose(50, 77 * k + offset)}" for k, item in enumerate(items) for offset in range(8)]
    got = pairs(decontaminate.contaminated(make_docs(spark, texts + [prose(300, 5000 + k) for k in range(60)]), bench(spark, items)))
    assert got == {(8 * k + offset, k) for k in range(len(items)) for offset in range(8)}


def test_long_items_with_changed_words(spark):
    items = [" ".join(f"{w}q{k}p{at // 40}" for at, w in enumerate(words(300, 1000 + k))) for k in range(4)]
    texts = [f"{prose(37 + 3 * k, k)} {paraphrase(t, k)} {prose(51, 50 + k)}" for k, t in enumerate(items)] + [prose(300, 900 + k) for k in range(60)]
    assert pairs(decontaminate.contaminated(make_docs(spark, texts), bench(spark, items))) == {(k, k) for k in range(4)}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 8)
    items = [" ".join(words(30, 1000 + k, 3000)) for k in range(12)]
    docs = make_docs(spark, [f"{prose(30, k)} {t} {prose(30, k + 50)}" for k, t in enumerate(items)])
    assert pairs(decontaminate.contaminated(docs, bench(spark, items))) == {(k, k) for k in range(12)}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    items = [None, "", "?!", "x", "no id here at all today", prose(600, 4)]
    got = pairs(decontaminate.contaminated(docs, bench(spark, items)))
    assert (None, 4) in got and all(i >= 3 for _, i in got)
    assert decontaminate.without_benchmark(docs, bench(spark, [])).count() == docs.count()
    assert pairs(decontaminate.contaminated(spark.createDataFrame([], SCHEMA), bench(spark, items))) == set()


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(200):
        a, b = (r.choices(range(5), k=r.randint(0, 30)) for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == slow(a, b)


def test_the_latent_space_is_that_of_all_passages(spark):
    """Against the singular vectors of the whole matrix: 3,000 documents with words of their own, more than a sample would hold."""
    r = np.random.default_rng(3)
    topics = [words(40, 50 + k, 4000) for k in range(12)]
    texts = [" ".join(r.choice(topics[k % 12], 32)) for k in range(3000)]
    docs, items = make_docs(spark, texts), decontaminate.read_items([(0, " ".join(topics[0][:20]))])
    rows = docs.select("doc_id", "text")
    frequency, passages = decontaminate.term_statistics(rows)
    idf = np.log((passages + 1) / (frequency + 1)) + 0.05
    space = decontaminate.fit_space(decontaminate.corpus_sketch(rows, idf), items, idf)
    whole = np.zeros((len(texts) + 1, decontaminate.FEATURES), np.float32)
    for at, h, borders in decontaminate.hashed_words([t.lower() for t in texts] + [" ".join(topics[0][:20])], decontaminate.BETWEEN):
        for d in range(len(borders) - 1):
            np.add.at(whole[at + d], (h[borders[d] : borders[d + 1]] % np.uint64(decontaminate.FEATURES)).astype(int), 1)
    whole *= idf
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    exact = np.linalg.svd(whole[:, whole.any(axis=0)], full_matrices=False)[2][:12]
    found = np.linalg.qr(space.directions[:-1][whole.any(axis=0)] / idf[whole.any(axis=0), None])[0]
    assert np.linalg.norm(exact @ found, axis=1).min() > 0.95  # the leading directions lie in the space


def by_rows(idf, column, sign, width, words, borders):
    """The sketch as sums of rows, feature by feature."""
    row, feature, count, passages = decontaminate._passages(words, borders)
    value = count * idf[feature]
    value = value / np.sqrt(np.bincount(row, value**2, minlength=passages))[row]
    product = np.bincount(row * width + column[feature], value * sign[feature], minlength=passages * width).reshape(passages, width).astype(np.float32)
    order = np.argsort(feature.astype(np.uint16), kind="stable")
    total = np.zeros((decontaminate.FEATURES, width), np.float32)
    for at in range(0, len(order), 1 << 15):
        some = order[at : at + (1 << 15)]
        first = np.flatnonzero(np.diff(feature[some], prepend=-1))
        total[feature[some][first]] += np.add.reduceat(product[row[some]] * value[some, None].astype(np.float32), first, axis=0)
    return total


def test_the_sketch_is_summed_in_products(monkeypatch):
    """op9: sums row by row took half of the query's CPU seconds. Sums are the same, also of a word in more passages than one product takes."""
    r, width = np.random.default_rng(3), 112
    words = (3000 * r.random(700_000) ** 6).astype(np.uint64) + np.uint64(1)
    words[::32] = 0  # once in each passage
    borders = np.array([0, 640_000, 640_000, 640_005, 700_000])
    args = 0.05 + r.random(decontaminate.FEATURES), *decontaminate._signs(width), width
    want = by_rows(*args, words, borders)
    sketch = decontaminate._Sketch(*args)
    monkeypatch.setattr(decontaminate.np, "add", None)  # no sums but those of products
    sketch.add(words, borders)
    monkeypatch.undo()
    assert np.abs(sketch.total - want).max() <= 1e-5 * np.abs(want).max()
    empty = decontaminate._Sketch(*args)
    empty.add(np.zeros(0, np.uint64), np.array([0, 0]))
    assert not empty.total.any()
