import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from basketweave.llm import toxicity
from tests.llm.test_neardup import word_sets
from tests.llm.test_tokens_packing import unpack

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    root, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return [d.toPandas() for d in out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[1:5])


def test_toxicity_drops_what_its_model_rejects(spark, stages):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.score(docs, toxicity.train(docs, labels), columns=["doc_id"]).collect()
    assert set(stages[1].doc_id) == {r["doc_id"] for r in scores if r["toxicity"] < 0.5}


def test_dedup_stages_match_brute_force(stages):
    first = {}
    for r in stages[1].sort_values("doc_id").itertuples():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(stages[2].doc_id) == sorted(first.values())
    sets, parent = [(r.doc_id, word_sets(r.text)) for r in stages[2].itertuples()], {i: i for i in stages[2].doc_id}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both):
                a_root, b_root = sorted((find(a), find(b)))
                parent[b_root] = a_root
    assert sorted(stages[3].doc_id) == sorted({find(i) for i in parent})


def test_decontamination_drops_documents_with_whole_items(spark, stages):
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = {r.doc_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in stages[3].itertuples()}
    assert set(stages[4].doc_id) == {i for i, t in plain.items() if not any(f" {x} " in f" {t} " for x in items)}


def test_packing_holds_every_token(spark, stages):
    texts = {r.doc_id: r.text for r in stages[4].itertuples()}
    unpack(stages[5].to_dict("records"), texts, 2048)
    assert set(stages[5].doc_id) == set(texts)


def test_run_gives_the_last_stage(spark, stages):
    got = entry.queries()["pipeline"](spark, DATA)
    assert got.count() == len(stages[5]) and got.agg(F.sum("length")).first()[0] == stages[5].length.sum()


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as the stages name their own keep their values."""
    from tests.llm.helpers import make_docs, prose

    own = ["text_sha", "kept_sha", "kept_place", "kept_id", "text_key", "kept_key", "found_key", "found_id", "toxicity", "text_scored", "__sha", "__key", "__place"]
    docs = make_docs(spark, [prose(30, 1), prose(30, 2), prose(30, 1), "an apple a day keeps doctors far away they say"])
    for c in own:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} of {r['doc_id']}" for c in own), name
