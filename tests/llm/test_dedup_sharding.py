import hashlib
import re
from collections import Counter, defaultdict

import pytest

from basketweave.llm import dedup, sharding
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose


def brute_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, min(known) if known else None, len(ids), sha) for i in ids]
    return Counter(out)


def test_matches_brute_force_with_a_hot_group(spark):
    texts = ["hot  text"] * 300 + [prose(20, k % 40) for k in range(100)] + ["hot text\n"] * 3
    docs = make_docs(spark, texts)
    got = dedup.exact_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_force(docs.collect())
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = dedup.exact_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_force(docs.collect())
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    left = dedup.keep_first_copies(docs)
    assert left.columns == docs.columns and left.count() == len(kept)


def test_empty_table(spark):
    assert dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert dedup.keep_first_copies(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_neighbours_in_the_sort_find_all_copies(spark):
    texts = [f"hot  {'text' * 20} {k % 7}" for k in range(400)] + [prose(20, k % 40) for k in range(100)] + [None, "", " ", "\t"]
    docs = make_docs(spark, texts)
    groups = {sha: (first, n) for (_, first, n, sha) in brute_force(docs.collect())}
    rows = dedup.content_sort(docs).collect()
    assert all((r["run_first"], r["run_size"]) == groups[r["text_sha256"]] and not r["dealt"] for r in rows)
    assert sum(r["run_place"] > 1 for r in rows) == len(texts) - len(groups)


def test_runs_of_hot_texts_are_put_together(spark):
    texts = ["hot  text"] * 300 + ["warm text"] * 50 + [prose(20, k % 40) for k in range(100)] + ["hot text\n"] * 3 + [(None, "hot text")] * 30
    docs = make_docs(spark, texts)
    hot = dedup.hot_texts(docs, least=40).collect()
    assert sorted(r["runs"] for r in hot) == [2, 9]  # the line feed becomes a space, so "hot text " is another text
    sizes = [r["run_size"] for r in dedup.content_sort(docs, hot=dedup.hot_texts(docs, least=40)).filter("dealt and run_place = 1").collect()]
    assert sum(sizes) == 380 and max(sizes) < 100
    got = dedup.exact_duplicates(docs, least_hot=40).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_force(docs.collect())
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got if r["doc_id"] is not None)


def test_one_exchange_moves_the_texts_and_no_python_runs(spark):
    plan = dedup.content_sort(make_docs(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


def claimed_in_turns(shards, slots):
    """The table by sets of free slots, straight from the definition."""
    import zlib

    orders = []
    for s in shards:
        at, skip = zlib.crc32(f"offset:{s}".encode()) % slots, zlib.crc32(f"skip:{s}".encode()) % (slots - 1) + 1
        orders.append([(at + j * skip) % slots for j in range(slots)])
    owner, free = {}, set(range(slots))
    while free:
        for i, order in enumerate(orders):
            if free:
                slot = next(x for x in order if x in free)
                owner[slot] = i
                free.remove(slot)
    return [owner[k] for k in range(slots)]


@pytest.mark.parametrize("n, slots", [(1, 2), (3, 13), (7, 101), (10, 211)])
def test_table_matches_its_definition(n, slots):
    names = [f"s{i}" for i in range(n)]
    table = sharding.fill_table(names, slots)
    assert table == claimed_in_turns(names, slots)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1


def test_a_new_shard_moves_few_slots():
    old, new = (sharding.fill_table([f"s{i}" for i in range(n)], 10_007) for n in (20, 21))
    assert sum(a != b for a, b in zip(old, new)) < 3 * 10_007 / 21


def test_bad_tables_are_refused():
    for names, slots in (([], 13), (["a", "a"], 13), (["a"], 12)):
        with pytest.raises(ValueError):
            sharding.fill_table(names, slots)


def test_placement_keeps_rows_and_columns(spark):
    docs = odd_docs(spark).withColumnRenamed("norm", "slot")
    placed = sharding.place(docs, "doc_id", 5, 101)
    assert placed.count() == docs.count() and set(placed.columns) == set(docs.columns) | {"shard"}
    table = sharding.fill_table([f"shard-{i}" for i in range(5)], 101)
    import hashlib as h

    for r in placed.collect():
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(h.md5(text.encode()).hexdigest()[:15], 16) % 101 and r["shard"] == table[r["slot"]]
    assert sharding.place(spark.createDataFrame([], SCHEMA)).count() == 0
