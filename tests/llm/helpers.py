"""Small document tables for the text operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Column names that the operators use inside.
CLASHES = ["id", "norm", "run", "node", "text_key", "page", "place", "ids", "n", "queue", "part", "sketch", "toxic", "score", "__key", "feature"]


def make_docs(spark, texts, sources=None):
    """Documents 0, 1, ... of the given texts; a pair (id, text) sets the id."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], len(text) if text is not None else None))
    return spark.createDataFrame(rows, SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty and white texts, a very long text, ties, wholly repeated rows, a repeated id."""
    long = " ".join(words(5000, seed=9))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "no id here at all today", "en", "a", 5),
        (4, long, "en", "b", len(long)), (5, "same text twice in two rows", "en", "a", 1), (5, "same text twice in two rows", "en", "a", 1),
        (6, "same  text twice\nin two rows", "en", "b", 1), (7, "x", "en", None, 1), (7, "another text with the same id", "en", "a", 1),
        (8, "Ünïcödé ☃ \U0001f600 é <|endoftext|>     end", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        docs = docs.selectExpr("*", f"cast(doc_id as string) AS `{c}`")
    return docs


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    pool = ["".join(random.Random(k).choices("abcdefghiklmnoprstuvw", k=3 + k % 6)) for k in range(vocabulary)]
    return [r.choice(pool) for _ in range(n)]


def prose(n, seed=0):
    return " ".join(words(n, seed))
