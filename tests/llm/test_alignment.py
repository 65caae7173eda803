import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basketweave.llm import alignment
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
HARD = [
    "", " ", "a  b   c\n\n d \t\n e", "It's we'll <|endoftext|> x", "</s> <s> <unk> end", "日本語 テキスト", "👩‍👩‍👧 \U0001f600 ☃", "a" * 700, "1234567 3.14 $5",
    "▁ underscore", "é é ﬁ Ａ ½", "  lead and trail  ", "\x00\x01 control", "tab\tend\r\n", "ça été où naïve", "🙂" * 50,
]


def brute_force(texts):
    """Tokens by the libraries themselves, groups by set intersection."""
    a_model, b_model = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    a_model.encode_special_tokens = True
    own = alignment.ByteLevel(FILES[0], None).bytes
    found = []
    for t in texts:
        a, b = a_model.encode(" " + (t or ""), add_special_tokens=False).ids, b_model.encode(t or "", num_threads=1)
        a_bytes = [own[i] for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            found.append(([], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        found.append((a, b, groups))
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for k, (a, b, groups) in enumerate(found):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = [(x[-1], y[-1]) for x, y in groups]
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((k, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def got(df):
    columns = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("ranks", [FILES[1], None])
def test_counts_match_brute_force(spark, ranks):
    r = random.Random(4)
    texts = [t for t in HARD if t != "▁ underscore"] + ["▁ underscore", None] + [prose(60, k) for k in range(6)] + [prose(60, 1)] * 3
    texts += ["".join(r.choices("ab's 1.\n\t\xa0éß日🙂 ", k=r.randint(1, 60))) for _ in range(80)]
    docs = make_docs(spark, texts).repartition(4)
    want = brute_force(texts)
    assert got(alignment.alignment_counts(docs, FILES[0], ranks, FILES[2], chars=500)) == want
    assert sum(w[3] > 0 for w in want) > 80


def test_divide_and_conquer_equals_intersection(monkeypatch):
    r = np.random.default_rng(0)
    for probes in (1, 2, 16):
        monkeypatch.setattr(alignment, "PROBES", probes)
        for density in (0.02, 0.3, 0.9):
            sides, to = [[], []], [[], []]
            size = 0
            for _ in range(30):
                length = int(r.integers(1, 400))
                for side, cuts in zip(sides, to):
                    own = np.flatnonzero(r.random(length - 1) < density) + 1
                    side += [*(own + size), length + size]
                    cuts.append(len(side))
                size += length
            a, b = (np.array(x) for x in sides)
            a_to, b_to = (np.array(x) for x in to)
            first = lambda x: np.concatenate(([0], x[:-1]))
            groups = alignment.shared_cuts(a, b, first(a_to), a_to, first(b_to), b_to)
            both = np.intersect1d(a, b)
            assert a[groups.a_end - 1].tolist() == both.tolist() == b[groups.b_end - 1].tolist()


def test_groups_give_the_texts_back(spark):
    texts = [prose(50, 2), HARD[2], HARD[6], None]
    own = alignment.Aligner(*FILES)
    for r in alignment.align(make_docs(spark, texts), *FILES).collect():
        t = texts[r["doc_id"]]
        a = b = 0
        joined = b""
        for i, j in zip(r["a_ends"], r["b_ends"]):
            left, right = (b"".join(t.bytes[k] for k in ids) for t, ids in ((own.a, r["a_ids"][a:i]), (own.b, r["b_ids"][b:j])))
            assert left == right
            joined, a, b = joined + left, i, j
        assert joined == ((" " + t).encode() if t else b"")


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark).withColumnRenamed("n", "links")
    found = got(alignment.alignment_counts(docs, *FILES).na.fill(-1))
    assert len(found) == docs.count() and found[0][0] == -1
    assert {f[1:] for f in found if f[0] in (1, 2)} == {(0, 0, 0, 0, 0, 0, "")}
    assert got(alignment.alignment_counts(spark.createDataFrame([], SCHEMA), *FILES)) == []


@pytest.mark.parametrize("text", ["ab " * 300_000, "9" * 60_000, "-" * 60_000])
def test_very_long_texts(spark, text):
    (row,) = got(alignment.alignment_counts(make_docs(spark, [text]), *FILES))
    assert row[3] > 0 and row[3] == row[4]
