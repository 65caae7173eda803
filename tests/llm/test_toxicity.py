import os
import random
import zlib

import pytest

from basketweave.llm import toxicity
from tests.llm.helpers import CLASHES, SCHEMA, odd_docs, prose

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id BIGINT, quality INT, toxic INT, text STRING"


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def trained(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test data not present")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, model = trained
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model, columns=["doc_id"]).collect()}
    english = {r["doc_id"] for r in docs.filter("lang = 'en'").collect()}  # words of other languages are too rare at this size
    pairs = [(truth[i], scores[i] >= 0.5) for i in truth if is_held_out(i)]
    assert all(y for y, p in pairs if p) and sum(y == p for y, p in pairs) >= 0.95 * len(pairs)
    assert all(scores[i] >= 0.5 for i in truth if is_held_out(i) and i in english and truth[i])


@pytest.mark.parametrize(
    "text, word",
    [("you 1d10t", "idiot"), ("m0r0n!", "moron"), ("looooser", "loser"), ("an i d i o t", "idiot"), ("p@thet1c", "pathetic"), ("m.o.r.o.n", "moron"), ("w0rthl3ss", "worthless"), ("id*ot", "idiot"), ("T R @ S H", "trash"), ("$cum", "scum")],
)
def test_disguised_words_are_decoded_and_scored(trained, text, word):
    model = trained[2]
    assert word in " ".join(toxicity.Restorer(model.cost).restored(toxicity.latin(text))).split()
    scorer = toxicity.Scorer(model)
    assert scorer.score(text) == scorer.score(f"{text} {word}") > scorer.score("")


@pytest.mark.parametrize("text, word", [("idio7", "idiot"), ("you tra5h", "trash"), ("s c u m", "scum"), ("s  c -- u m", "scum"), ("l0$er$ idio7", "idiot"), ("an i\nd  i . o t", "idiot")])
def test_signs_at_the_end_and_any_separators_are_decoded(trained, text, word):
    assert word in " ".join(toxicity.Restorer(trained[2].cost).restored(toxicity.latin(text))).split()


@pytest.mark.parametrize("text", ["a$$", "dumba55", "d i e", "ab4"])
def test_lattices_for_signs_at_the_end_and_three_single_characters(text):
    """The language model decides; here it knows these words only."""
    cost = toxicity.array("f", [9.0]) * (1 << toxicity.BITS * toxicity.ORDER)
    word = {"a$$": "ass", "dumba55": "dumbass", "d i e": "die", "ab4": "ab"}[text]
    at = 0
    for c in word + " ":
        packed = at << toxicity.BITS | (0 if c == " " else ord(c) - 96)
        cost[packed], at = 0.1, packed & 0x7FFF
    assert toxicity.suspicious(toxicity.latin(text))
    assert word in " ".join(toxicity.Restorer(cost).restored(toxicity.latin(text))).split()


def test_viterbi_finds_the_cheapest_reading(trained):
    """Against all readings of short tokens."""
    import itertools

    cost = trained[2].cost

    def price(reading):
        at = total = 0
        for c in reading + " ":
            packed = at << toxicity.BITS | (0 if c == " " else ord(c) - 96)
            total, at = total + cost[packed], packed & 0x7FFF
        return total

    for token in ("1d10t", "he11o", "s3ee", "a-b c", "t00l"):
        options = toxicity.lattice(token)
        best = min(itertools.product(*options), key=lambda c: sum(x for _, x in c) + price("".join(t for t, _ in c)))
        assert toxicity.viterbi(options, cost) == "".join(t for t, _ in best).strip()


def test_clean_numbers_and_marks_are_left_alone():
    for text in ("of 12 in 2023", "wait... what?!", "the%%% end***", "call 555-0123", "aa bb", ""):
        assert not toxicity.suspicious(toxicity.latin(text)), text


def test_labels_of_held_out_documents_are_not_used(spark):
    r = random.Random(1)
    rows = [(i, prose(30, i) + (" vile" if r.random() < 0.3 else ""), "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    right = spark.createDataFrame([(i, 1, int("vile" in t), t) for i, t, *_ in rows], LABELS)
    wrong = spark.createDataFrame([(i, 1, int("vile" in t) if not is_held_out(i) else 1 - int("vile" in t), "") for i, t, *_ in rows], LABELS)
    a, b = toxicity.train(docs, right), toxicity.train(docs, wrong)
    assert a.places == b.places and a.weights == pytest.approx(b.weights) and a.intercept == pytest.approx(b.intercept) and b"vile" in a.places
    got = toxicity.score_documents(docs, right).collect()
    assert all(r["predicted"] == ("vile" in rows[r["doc_id"]][1]) and r["held_out"] == is_held_out(r["doc_id"]) for r in got)


@pytest.mark.parametrize("word", ["мерзкий", "βλάκας", "غبي", "सड़ा", "笨蛋", "gówniarz", "sœur"])
def test_words_of_any_script_are_learned(spark, word):
    r, glue = random.Random(2), "" if word == "笨蛋" else " "
    other = ["хороший", "день", "你好", "ещё", "łąka"]
    texts = [glue.join([r.choice(other), *([word] if k % 3 == 0 else []), r.choice(other)]) for k in range(300)]
    docs = spark.createDataFrame([(k, t, "xx", "a", 1) for k, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0), t) for k, t in enumerate(texts)], LABELS)
    got = toxicity.score_documents(docs, labels).collect()
    assert all(row["predicted"] == (row["doc_id"] % 3 == 0) for row in got)


@pytest.mark.parametrize("text", ["you idіоt", "you ｉｄｉｏｔ", "you id\u200biot", "you 𝐢𝐝𝐢𝐨𝐭", "you іd1оt"])
def test_letters_that_look_alike(trained, text):
    assert b"idiot" in toxicity.Restorer(trained[2].cost).words(text)
    assert toxicity.latin("łąka œuf") == b"laka oeuf" and b"\xd1" not in toxicity.latin("мерзкий")


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(None, 1, 1, ""), (4, None, None, None), (5, 1, 1, ""), (5, 1, 0, ""), (99, 1, 0, "")], LABELS)
    for table in (labels, labels.filter("doc_id < 0")):
        got = toxicity.score_documents(docs, table)
        assert got.count() == docs.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    kept = toxicity.score(docs, toxicity.train(docs, labels))
    assert set(kept.columns) == set(docs.columns) | {"toxicity"} and set(CLASHES) <= set(kept.columns)
    assert toxicity.score_documents(spark.createDataFrame([], SCHEMA), labels).collect() == []
