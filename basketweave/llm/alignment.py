"""Alignment of two tokenizers' tokens: texts are cut where tokens of both end, by divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import worker_value
from .common import Scratch, map_arrow, text_or_empty

#: Characters of texts that a worker holds as tokens at a time (a longer text alone).
CHARS = 1_000_000
#: Places beside the middle that are tried one by one before the rest of an interval is searched at once.
PROBES = 16


class ByteLevel:
    """Ids by the byte-level BPE tokenizer; ``ranks_path`` names the same vocabulary as ranks, which encodes faster."""

    def __init__(self, json_path: str, ranks_path: str | None):
        import base64
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(json_path)
        tokenizer.encode_special_tokens = True  # their strings are plain text
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        to_byte = {c: b for b, c in enumerate(_byte_characters())}
        self.bytes = [bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t in map(tokenizer.id_to_token, range(size))]
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class Pieces:
    """Ids by the piece tokenizer, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(self.model.id_to_piece, ids))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@dataclass
class Groups:
    """Leaf groups in text order: the places after their last A and B token."""

    a_end: np.ndarray
    b_end: np.ndarray


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> Groups:
    """Divide and conquer over many texts at once.

    ``a_ends`` and ``b_ends`` are ascending byte ends of all tokens; text k holds the A tokens ``a_from[k]`` to
    ``a_to[k]`` and likewise B tokens, and its last ends agree. In each interval the A end in the middle, then its
    neighbours outwards, are looked up among the B ends by bisection; the first that both have cuts the interval in two
    halves, which are treated alike. An interval without such an end is a leaf. All intervals of one depth are worked on together.
    """
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    some = a_to > a_from
    a0, a1, b0, b1 = (x[some] for x in (a_from, a_to, b_from, b_to))
    while len(a0):
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        middle = (a0 + a1 - 2) // 2
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        for k in range(PROBES):
            if not len(open_):
                break
            step = (k + 1) // 2 * (1 if k % 2 else -1)
            at = middle[open_] + step
            inside = (at >= a0[open_]) & (at < a1[open_] - 1)
            mine, at = open_[inside], at[inside]
            in_b = np.searchsorted(b_ends, a_ends[at])
            met = b_ends[in_b] == a_ends[at]
            cut_a[mine[met]], cut_b[mine[met]] = at[met], in_b[met]
            open_ = open_[(cut_a[open_] < 0) & (middle[open_] - a0[open_] + 1 >= k // 2) & (a1[open_] - a0[open_] > k)]
        for i in open_.tolist():  # long stretches without a cut near their middle
            own = a_ends[a0[i] : a1[i] - 1]
            in_b = np.searchsorted(b_ends, own)
            met = np.flatnonzero(b_ends[in_b] == own)
            if len(met):
                near = met[np.argmin(np.abs(met + a0[i] - middle[i]))]
                cut_a[i], cut_b[i] = a0[i] + near, in_b[near]
        split = cut_a >= 0
        leaves.append((a1[~split], b1[~split]))
        halves = ((a0[split], cut_a[split] + 1), (cut_a[split] + 1, a1[split]), (b0[split], cut_b[split] + 1), (cut_b[split] + 1, b1[split]))
        a0, a1 = (np.stack((halves[0][k], halves[1][k]), 1).ravel() for k in (0, 1))
        b0, b1 = (np.stack((halves[2][k], halves[3][k]), 1).ravel() for k in (0, 1))
    if not leaves:
        return Groups(np.zeros(0, np.int64), np.zeros(0, np.int64))
    a_end, b_end = (np.concatenate([x[k] for x in leaves]) for k in (0, 1))
    order = np.argsort(a_end)
    return Groups(a_end[order], b_end[order])


class Aligner:
    """Both tokenizers in a worker, with tables of their tokens' bytes and lengths."""

    def __init__(self, json_path: str, ranks_path: str | None, piece_path: str):
        self.a, self.b = ByteLevel(json_path, ranks_path), Pieces(piece_path)
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        # Decimal ids with what follows them in a written group: A id, A id at the end, B id, B id at the end.
        marks = ((self.a, b","), (self.a, b"|"), (self.b, b","), (self.b, b";"))
        self.written = [str(i).encode() + mark for t, mark in marks for i in range(len(t.bytes))]
        self.a_last, self.b_first = len(self.a.bytes), 2 * len(self.a.bytes)
        self.b_last = self.b_first + len(self.b.bytes)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids; none where either's bytes differ from a space and the text."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        spaced = " " + text
        a, b, want = self.a.encode(spaced), self.b.encode(text), spaced.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b.bytes.__getitem__, b)) != want:
            return none, none
        return np.array(a, np.int32), np.array(b, np.int32)

    def aligned(self, texts: list[str]) -> dict:
        """Ids of all texts in a row, the groups' ends, and where each text's tokens and groups end."""
        found = [self.tokens(t) for t in texts]
        a_ids, b_ids = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int32)]) for k in (0, 1))
        a_to, b_to = (np.cumsum([len(f[k]) for f in found], dtype=np.int64) for k in (0, 1))
        a_from, b_from = (np.concatenate(([0], x[:-1])) if len(x) else x for x in (a_to, b_to))
        groups = shared_cuts(np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]), a_from, a_to, b_from, b_to)
        return {"a_ids": a_ids, "b_ids": b_ids, "a_to": a_to, "b_to": b_to, "groups": groups, "g_to": np.searchsorted(groups.a_end, a_to, side="right")}

    def digests(self, x: dict) -> list[str]:
        """SHA-256 of each text's written groups; empty for texts without tokens."""
        groups, a_ids, b_ids = x["groups"], x["a_ids"], x["b_ids"]
        a_n, b_n = np.diff(groups.a_end, prepend=0), np.diff(groups.b_end, prepend=0)
        a_codes, b_codes = a_ids.astype(np.int64), b_ids + np.int64(self.b_first)
        a_codes[groups.a_end - 1] += self.a_last
        b_codes[groups.b_end - 1] += self.b_last - self.b_first
        row = np.empty(len(a_ids) + len(b_ids), np.int64)
        row[np.arange(len(a_ids)) + np.repeat(groups.b_end - b_n, a_n)] = a_codes
        row[np.arange(len(b_ids)) + np.repeat(groups.a_end, b_n)] = b_codes
        out, start, written = [], 0, self.written.__getitem__
        for end in (x["a_to"] + x["b_to"]).tolist():
            out.append(hashlib.sha256(b"".join(map(written, row[start:end].tolist()))[:-1]).hexdigest() if end > start else "")
            start = end
        return out


def _some_texts(column: pa.Array, chars: int) -> Iterator[list[str]]:
    some, size = [], 0
    for t in column:
        text = t.as_py()
        if some and size + len(text) > chars:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _lists(values: np.ndarray, to: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to)), pa.int32()), pa.array(values))


def align(docs: DataFrame, json_path: str, ranks_path: str | None, piece_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """One row per document: doc_id, a_ids, b_ids and the groups as a_ends, b_ends (tokens up to each group's end).

    With ``digest`` the row holds doc_id, n_a, n_b, n_groups, groups_sha256 and links instead. Tokens hold at least a
    byte, so at each shared end one A and one B token end, and ``links`` has one entry ``a * |B| + b`` for each group.
    Null and empty texts, and texts that either tokenizer changes, have no tokens. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_value(("aligner", json_path, ranks_path, piece_path), lambda: Aligner(json_path, ranks_path, piece_path))
        width = np.int64(len(own.b.bytes))
        for b in batches:
            at = 0
            for texts in _some_texts(b.column("text"), chars):
                x = own.aligned(texts)
                ids, at = b.column("doc_id").slice(at, len(texts)), at + len(texts)
                groups, g_to = x["groups"], x["g_to"]
                if digest:
                    links = x["a_ids"][groups.a_end - 1] * width + x["b_ids"][groups.b_end - 1]
                    counts = [pa.array(np.diff(c, prepend=0).astype(np.int64)) for c in (x["a_to"], x["b_to"], g_to)]
                    yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(own.digests(x)), _lists(links, g_to)], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
                else:
                    n = np.diff(g_to, prepend=0)
                    ends = [(e - np.repeat(np.concatenate(([0], to[:-1])), n)).astype(np.int32) for e, to in ((groups.a_end, x["a_to"]), (groups.b_end, x["b_to"]))]
                    lists = [_lists(x["a_ids"], x["a_to"]), _lists(x["b_ids"], x["b_to"]), *(_lists(e, g_to) for e in ends)]
                    yield pa.RecordBatch.from_arrays([ids, *lists], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>" if digest else "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    return map_arrow(rows, run, f"doc_id {kind}, {columns}")


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n: how often each id pair is linked in all documents; a task sums up what it has read.

    Of two tokens that end together one's bytes end with the other's, so there are at most as many pairs as the
    tokens of both vocabularies have bytes (times two for bytes that two B ids share): a bound without the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            both, where = np.unique(np.concatenate((keys, new)), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, where, np.concatenate((counts, n)))
            keys, counts = both, total
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["link", "n"])

    return map_arrow(aligned.select("links"), run, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def alignment_counts(docs: DataFrame, json_path: str, ranks_path: str | None, piece_path: str, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded once; digests and links are written to the shared folder, the links are counted, and the counts
    (bounded by the vocabularies, see ``link_counts``) are broadcast. n_best counts the links whose pair is the most
    frequent of its B id (ties included), count_sum adds the counts of all links. Null, empty and changed texts have zeros
    and an empty digest; repeated rows count each; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    aligned = scratch.put(align(docs, json_path, ranks_path, piece_path, True, id_col, text_col, chars), "alignment")
    table = link_counts(aligned).orderBy("link").toArrow()
    keys, counts = (table[c].to_numpy().astype(np.int64) for c in ("link", "n"))
    width = len(Pieces(piece_path).bytes)
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, keys % width, counts)
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts, counts == highest[keys % width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for b in batches:
            links = b.column("links")
            place = np.searchsorted(keys, links.flatten().to_numpy())
            to = links.offsets.to_numpy() - links.offsets[0].as_py()
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[place], dtype=np.int64)))[to]) for v in (best, counts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(np.diff(to).astype(np.int64)), *map(pa.array, sums), b.column("groups_sha256")], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = aligned.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in names[1:-1])
    return map_arrow(aligned, run, f"doc_id {kind}, {longs}, groups_sha256 string")
