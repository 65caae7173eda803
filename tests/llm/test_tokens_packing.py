import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basketweave.llm import packing, tokens
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
HARD = [
    "", " ", "a  b   c\n\n d \t\n e", "It's we'll I'M 'tis", "x\x1cy\xa0z　w v", "<|endoftext|>x <|startoftext|>", "<|ENDOFTEXT|>", "é É ß ΑΣ İ",
    "日本語 テキスト", "👩‍👩‍👧 \U0001f600", "a" * 3000, "1234567 3.14 $5", "\n \n  \n", "  lead and trail  ", "᠎​ mid", "don''t...!!!???",
]


def test_counts_match_the_library(spark):
    texts = HARD + [prose(300, k) for k in range(5)] + [None]
    library = Tokenizer.from_file(WORD)
    for most in (0, 50):
        got = {r["doc_id"]: r for r in tokens.count_tokens(make_docs(spark, texts), WORD, limit=100, table_chunks=most).collect()}
        for i, t in enumerate(texts):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t


def test_random_strings_match_the_library():
    r, library = random.Random(3), Tokenizer.from_file(WORD)
    alphabet = "ab'st 1.\n\t\xa0é́İΣς<|endoftext|>ſK "
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(500)]
    cache = tokens.ChunkCache(lambda c: tokens._lengths(library, c), generation=20)
    assert tokens.count_texts(texts, library, cache) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_rows_are_counted(spark):
    docs = odd_docs(spark)
    assert tokens.count_tokens(docs, WORD).count() == docs.count()
    assert tokens.count_tokens(spark.createDataFrame([], SCHEMA), WORD).collect() == []


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_encoder_gives_the_library_s_ids(ranks):
    r, library, own = random.Random(5), Tokenizer.from_file(BYTE), packing.Encoder(BYTE, ranks)
    texts = HARD + [prose(100, k) for k in range(3)] + ["".join(r.choices("ab's 1.\n\t\xa0é́ ", k=r.randint(0, 40))) for _ in range(300)]
    for t, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids + [1], t


def in_due_order(totals, weights):
    due = sorted(((2 * i + 1) / (2 * w), q) for q, (t, w) in enumerate(zip(totals, weights)) for i in range(t))
    return [q for _, q in due]


@pytest.mark.parametrize(
    "totals, weights",
    [([30, 50, 7], [30, 50, 7]), ([100, 1, 1, 1], [100, 1, 1, 1]), ([40, 40, 5], [1, 3, 1]), ([5], [5]), ([1, 200, 3], [7, 1, 1]), ([9, 9, 9], [1, 1, 1])],
)
def test_mixture_follows_due_order(totals, weights):
    mixture, order = packing.Mixture(totals, weights, window=16), in_due_order(totals, weights)
    for k in range(mixture.windows + 1):
        served = mixture.before(k)[0]
        assert served == [order[: mixture.slots_before(k)].count(q) for q in range(len(totals))], k
    for q, t in enumerate(totals):  # pieces of a queue lie back to back
        at = 0
        for n in (1, t // 2, t - t // 2 - 1):
            for k, offset, start, length in mixture.pieces(q, at, n, 0) if n > 0 else ():
                assert mixture.before(k)[0][q] <= at + start and at + start + length <= mixture.before(k + 1)[0][q]
            at += max(n, 0)


def unpack(rows, texts_by_id, window):
    library = Tokenizer.from_file(BYTE)
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at & (at - 1) == 0
    for doc_id, text in texts_by_id.items():
        ids, at = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return sequences


def test_every_id_lies_in_one_piece_and_windows_keep_the_mixture(spark):
    texts = [prose(200 + k % 50, k) for k in range(60)] + [None, ""]
    docs = make_docs(spark, texts, sources=["hot", "hot", "hot", "b", "c", None]).repartition(5)
    rows = packing.pack(docs, BYTE, RANKS, window=256).collect()
    sequences = unpack(rows, dict(enumerate(texts)), 256)
    total, of = sum(r["length"] for r in rows), {}
    for r in rows:
        of[r["source"]] = of.get(r["source"], 0) + r["length"]
    for s in sequences.values():
        if sum(r["length"] for r in s) == 256:
            for source, n in of.items():
                assert abs(sum(r["length"] for r in s if r["source"] == source) - 256 * n / total) < 2


def test_targets_hold_until_a_source_ends(spark):
    texts = [prose(300, k) for k in range(40)]
    docs = make_docs(spark, texts, sources=["a", "b"])
    rows = packing.pack(docs, BYTE, RANKS, targets={"a": 3, "b": 1}, window=128).collect()
    first = [r for r in rows if r["sequence_id"] < 20]
    assert abs(sum(r["length"] for r in first if r["source"] == "a") / sum(r["length"] for r in first) - 0.75) < 0.01
    unpack(rows, dict(enumerate(texts)), 128)


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 4)
    texts = [prose(50, k) for k in range(30)]
    unpack(packing.pack(make_docs(spark, texts, sources=list("abcdefgh")), BYTE, RANKS, window=64).collect(), dict(enumerate(texts)), 64)


def test_odd_rows_are_packed(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, BYTE, RANKS).collect()
    library = Tokenizer.from_file(BYTE)
    assert sum(r["length"] for r in rows) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE, RANKS).collect() == []
