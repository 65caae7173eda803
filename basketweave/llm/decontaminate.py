"""Benchmark passages in documents: latent semantic retrieval, then common subsequences and an answer check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, map_arrow, text_or_empty
from .shingles import combine, hashed_words

#: Terms are words hashed to so many features; a passage for the term statistics has so many words.
FEATURES, PASSAGE = 1 << 15, 32
#: Dimensions of the latent space, and of the random sketch beyond them. The space is fitted on all passages and items.
RANK, OVERSAMPLE = 96, 16
#: Windows begin every STEP words and are so many steps long; each item is compared with windows of about its length.
STEP, LENGTHS = 8, (1, 2, 4, 7)
#: Items of fewer words than SHORT are also compared with windows of just their length at every word; items of more than
#: MOST words are looked for by pieces of the longest window. Runs of ANCHOR words of an item (all words of a shorter one)
#: are looked up as they stand, so that no verbatim copy rests on the latent space.
SHORT, MOST, ANCHOR = 15, 59, 8
#: Least cosine of a candidate; least share of an item's words in its longest common subsequence with the passage,
#: alone, and together with the words of its answer.
LEAST_COSINE, LEAST_LCS, LEAST_LCS_WITH_ANSWER = 0.6, 0.75, 0.5
#: Items compared in one scan of the documents (the bound of the broadcast); more items take more scans.
ITEM_BLOCK = 4_096

#: ASCII characters other than letters and digits stand between words.
BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t.lower() for t in batch.column(name).to_pylist()]


def term_statistics(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many passages each feature occurs, and the number of passages, over all rows and whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for _, words, borders in hashed_words(_texts(b), BETWEEN):
                n = np.diff(borders)
                local = np.arange(len(words)) - np.repeat(borders[:-1], n)
                first = np.concatenate(([0], np.cumsum(-(-n // PASSAGE))))
                where = np.repeat(first[:-1], n) + local // PASSAGE
                pairs = where * FEATURES + (words % np.uint64(FEATURES)).astype(np.int64)
                pairs = np.sort(pairs.astype(np.int32) if first[-1] < 1 << 16 else pairs)
                pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs
                total += np.bincount(pairs % FEATURES, minlength=FEATURES)
                passages += int(first[-1])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int32()), pa.array([passages, *total[found]], pa.int64())], ["feature", "n"])

    counted = map_arrow(docs.select(text_or_empty(text_col).alias("text")), run, "feature int, n bigint")
    rows = counted.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["feature"].to_pylist(), rows["n"].to_pylist()))
    passages = int(found.pop(-1, 0))
    out = np.zeros(FEATURES)
    out[list(found)] = list(found.values())
    return out, passages


@dataclass
class Item:
    """A benchmark item: id, hashed words, those of its last sentence, and its length class."""

    item_id: int
    words: np.ndarray
    answer: frozenset
    length: int

    def pieces(self) -> list[np.ndarray]:
        """The words whole, or in pieces of the longest window (the last one ends with the item)."""
        n, size = len(self.words), max(LENGTHS) * STEP
        if n <= MOST:
            return [self.words]
        return [self.words[at : at + size] for at in (*range(0, n - size, size), n - size)]

    def anchors(self) -> list[tuple[int, int]]:
        """Hash and place of runs of ANCHOR words."""
        n, size = len(self.words), min(ANCHOR, len(self.words))
        grams = combine(self.words, size)
        return [(int(grams[at]), at) for at in (*range(0, n - size, size), n - size)]


def read_items(rows: list) -> list[Item]:
    """Items of (item_id, text) rows; items without words can't occur and are left out."""
    out = []
    for item_id, text in rows:
        text = (text or "").lower()
        sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
        ((_, words, _),) = list(hashed_words([text], BETWEEN))
        ((_, answer, _),) = list(hashed_words([sentences[-1] if sentences else ""], BETWEEN))
        if len(words):
            length = min(LENGTHS, key=lambda k: abs(k * STEP - len(words)))
            out.append(Item(item_id, words, frozenset(answer.tolist()), length))
    return out


@dataclass
class Space:
    """The latent space: for each feature its idf times its part in the right singular vectors, over the singular values.

    The division keeps the few directions that tell languages apart from drowning all others. A last row of
    zeros stands for no word.
    """

    directions: np.ndarray

    def of_text(self, words: np.ndarray) -> np.ndarray:
        return self.directions[(words % np.uint64(FEATURES)).astype(np.int64)].sum(axis=0)

    def of_steps(self, words: np.ndarray, borders: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each STEP words in a row, text by text with ``gap`` zero rows after each; row at which each text begins."""
        n = np.diff(borders)
        rows = np.concatenate(([0], np.cumsum(-(-n // STEP) + gap)))
        index = np.full(int(rows[-1]) * STEP, FEATURES, np.int64)
        index[np.arange(len(words)) + np.repeat(rows[:-1] * STEP - borders[:-1], n)] = words % np.uint64(FEATURES)
        index = index.reshape(-1, STEP)
        sums, one = self.directions[index[:, 0]], np.empty((len(index), self.directions.shape[1]), np.float32)
        for j in range(1, STEP):
            np.take(self.directions, index[:, j], axis=0, out=one)
            sums += one
        return sums, rows


def _passages(words: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, feature and count of each distinct feature of a passage, by passage; and the number of passages."""
    n = np.diff(borders)
    local = np.arange(len(words)) - np.repeat(borders[:-1], n)
    first = np.concatenate(([0], np.cumsum(-(-n // PASSAGE))))
    pairs = (np.repeat(first[:-1], n) + local // PASSAGE) * FEATURES + (words % np.uint64(FEATURES)).astype(np.int64)
    pairs, count = np.unique(pairs.astype(np.int32) if first[-1] < 1 << 16 else pairs, return_counts=True)
    return pairs // FEATURES, pairs % FEATURES, count, int(first[-1])


class _Sketch:
    """Sums A'(A G) over TF-IDF passages A, whose rows have length 1, for a G with one sign in each row.

    A G takes one addition for each feature of a passage, so only the product with A' has ``width`` columns to add.
    """

    def __init__(self, idf: np.ndarray, column: np.ndarray, sign: np.ndarray, width: int):
        self.idf, self.column, self.sign, self.width = idf, column, sign, width
        self.total = np.zeros((FEATURES, width), np.float32)

    def add(self, words: np.ndarray, borders: np.ndarray) -> None:
        row, feature, count, passages = _passages(words, borders)
        value = count * self.idf[feature]
        value /= np.maximum(np.sqrt(np.bincount(row, value**2, minlength=passages))[row], 1e-9)
        cell = row.astype(np.int64) * self.width + self.column[feature]
        product = np.bincount(cell, value * self.sign[feature], minlength=passages * self.width).astype(np.float32).reshape(passages, self.width)
        order = np.argsort(feature.astype(np.uint16), kind="stable")
        feature, row, value = feature[order], row[order], value[order].astype(np.float32)
        first = np.flatnonzero(np.diff(feature, prepend=-1))
        within = np.arange(len(feature)) - np.repeat(first, np.diff(np.append(first, len(feature))))
        first = np.flatnonzero(within % (1 << 14) == 0)  # parts of this length are multiplied one by one
        n = np.diff(np.append(first, len(feature)))
        # Features of about as many passages are multiplied together, each padded with weights of 0: additions row by row take thrice as long.
        size = np.where(n <= 8, n, np.where(n <= 64, -(-n // 8) * 8, 1 << np.ceil(np.log2(n)).astype(np.int64)))
        for some in _alike(size, 1 << 14):
            place = first[some, None] + np.arange(size[some[0]])
            held = np.arange(size[some[0]]) < n[some, None]
            place = np.where(held, place, 0)
            weight = np.where(held, value[place], np.float32(0))
            self.total[feature[first[some]]] += np.matmul(weight[:, None], product[row[place]])[:, 0]


def _alike(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of equal sizes, as many at a time as add up to ``most`` (one at least)."""
    order = np.argsort(size, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        step = max(1, most // int(size[own[0]])) if len(own) else 1
        for at in range(0, len(own), step):
            yield own[at : at + step]


def corpus_sketch(docs: DataFrame, idf: np.ndarray, rank: int = RANK, text_col: str = "text") -> np.ndarray:
    """A'(A G) over the passages of all rows, in one pass; G as ``_signs`` gives it.

    A task adds up what it has read, and there are twice as many tasks as cores, so the partial sums don't grow with the input.
    What reaches the driver is one features x sketch matrix.
    """
    context, width = docs.sparkSession.sparkContext, rank + OVERSAMPLE
    shared = context.broadcast((idf, *_signs(width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _Sketch(*shared.value, width)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for _, words, borders in hashed_words(_texts(b.slice(at, 512)), BETWEEN):
                    sketch.add(words, borders)
        used = np.flatnonzero(np.abs(sketch.total).sum(axis=1))
        kind, ends = pa.list_(pa.float32()), np.arange(len(used) + 1, dtype=np.int32) * width
        rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch.total[used].ravel(), pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), rows.cast(kind)], ["i", "row"])

    texts = docs.select(text_or_empty(text_col).alias("text")).coalesce(2 * context.defaultParallelism)
    parts = map_arrow(texts, run, "i int, row array<float>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(width)]).toArrow()
    shared.unpersist()
    out, at = np.zeros((FEATURES, width)), rows["i"].to_numpy()
    for k in range(width):
        out[at, k] = rows[f"c{k}"].to_numpy()
    return out


def _signs(width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each feature its column of G and its sign there."""
    r = np.random.Generator(np.random.PCG64(7))
    return r.integers(0, width, FEATURES), r.choice([-1.0, 1.0], FEATURES)


def fit_space(corpus: np.ndarray, items: list[Item], idf: np.ndarray, rank: int = RANK) -> Space:
    """The right singular vectors of the TF-IDF passages of all documents (their ``corpus_sketch``) and of the items.

    Of Y = A'A G the Nystroem form Y (G'Y)^-1 Y' stands for A'A; a small multiple of G is added to Y and taken off the
    eigenvalues again, so that few passages do no harm.
    """
    width = rank + OVERSAMPLE
    column, sign = _signs(width)
    own = _Sketch(idf, column, sign, width)
    own.add(np.concatenate([i.words for i in items]), np.cumsum([0] + [len(i.words) for i in items]))
    shift = 1e-6 * max(float(np.linalg.norm(corpus + own.total)), 1e-9)
    y = corpus + own.total
    y[np.arange(FEATURES), column] += shift * sign
    core = np.zeros((width, width))
    np.add.at(core, column, y * sign[:, None])
    core = (core + core.T) / 2
    turned, turn = np.linalg.eigh(core)
    keep = turned > 1e-9 * turned[-1]
    left, singular, _ = np.linalg.svd(y @ (turn[:, keep] / np.sqrt(turned[keep])), full_matrices=False)
    values = np.maximum(singular[:rank] ** 2 - shift, 0.0)
    known = values > 1e-3 * values[0]  # few passages span fewer directions
    right = left[:, :rank] * np.where(known, 1 / np.sqrt(np.maximum(values, 1e-3 * values[0])), 0.0)
    right = np.pad(right, ((0, 0), (0, rank - right.shape[1])))
    return Space(np.concatenate((idf[:, None] * right, np.zeros((1, rank)))).astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _compare(item: Item, words: np.ndarray, start: int, end: int, more: int = 0) -> float:
    """Share of the item's words in its longest common subsequence with the passage around words start to end; 0 if it doesn't hold the answer either."""
    margin = max(STEP, len(item.words) - (end - start) + STEP) + more
    near = words[max(0, start - margin) : max(0, end + margin)].tolist()
    share = common_subsequence(item.words.tolist(), near) / len(item.words)
    if share >= LEAST_LCS or share >= LEAST_LCS_WITH_ANSWER and item.answer <= set(near):
        return share
    return 0.0


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    m = np.array(rows)
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _scan(docs: DataFrame, items: list[Item], space: Space, kind: str) -> DataFrame:
    """doc_id, text_key, item_id, cosine, lcs_share of the documents that hold one of ``items``."""
    by_length, short, anchors = {}, {}, {}
    for k in LENGTHS:
        own = [(i, piece) for i, item in enumerate(items) if item.length == k for piece in item.pieces()]
        if own:
            by_length[k] = [i for i, _ in own], _unit([space.of_text(piece) for _, piece in own]).T
    for n in {len(i.words) for i in items if len(i.words) < SHORT}:
        own = [i for i, item in enumerate(items) if len(item.words) == n]
        short[n] = own, _unit([space.of_text(items[i].words) for i in own]).T
    for i, item in enumerate(items):
        for gram, at in item.anchors():
            anchors.setdefault(min(ANCHOR, len(item.words)), {}).setdefault(gram, []).append((i, at))
    anchors = {n: (np.array(sorted(grams), np.uint64), grams) for n, grams in anchors.items()}
    shared = docs.sparkSession.sparkContext.broadcast((items, by_length, short, anchors, space))

    def like(windows: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Row, column and cosine of the candidates."""
        least = np.sqrt(np.einsum("ij,ij->i", windows, windows))[:, None]
        dots = windows @ matrix
        for w, i in zip(*np.nonzero((dots >= LEAST_COSINE * least) & (least > 1e-6))):
            yield int(w), int(i), float(dots[w, i] / least[w, 0])

    def verbatim(words: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """Hits around runs of words that an item has too."""
        items, _, _, anchors, latent = shared.value
        done = set()
        for n, (known, grams) in anchors.items():
            if len(words) < n:
                continue
            found = combine(words, n)
            near = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for w in np.flatnonzero(known[near] == found).tolist():
                d = int(np.searchsorted(borders, w, side="right")) - 1
                if w + n > borders[d + 1]:
                    continue
                here = words[borders[d] : borders[d + 1]]
                for i, at in grams[int(found[w])]:
                    start = w - int(borders[d]) - at
                    if (d, i, start) not in done:
                        done.add((d, i, start))
                        end = start + len(items[i].words)
                        if share := _compare(items[i], here, start, end):
                            a, b = latent.of_text(items[i].words), latent.of_text(here[max(0, start) : end])
                            yield d, i, float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9)), share

    def at_every_word(words: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """Hits of short items."""
        items, _, short, _, latent = shared.value
        for n, (own, matrix) in short.items():
            for at in range(0, len(words) - n + 1, 1 << 14):
                rows = latent.directions[(words[at : at + (1 << 14) + n - 1] % np.uint64(FEATURES)).astype(np.int64)]
                windows = rows[: len(rows) - n + 1].copy()
                for j in range(1, n):
                    windows += rows[j : j + len(windows)]
                for w, i, cosine in like(windows, matrix):
                    d = int(np.searchsorted(borders, at + w, side="right")) - 1
                    start = at + w - int(borders[d])
                    if share := _compare(items[own[i]], words[borders[d] : borders[d + 1]], start, start + n):
                        yield d, own[i], cosine, share

    def at_every_step(words: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """Hits of items and pieces of items."""
        items, classes, _, _, latent = shared.value
        sums, rows = latent.of_steps(words, borders, max(LENGTHS) - 1)
        windows, done, seen = sums, 1, {}
        for k in LENGTHS:
            if k > done:  # longer windows from those of the length before
                longer = windows.copy()
                for j in range(done, k):
                    longer[: len(sums) - j] += sums[j:]
                windows, done = longer, k
            if k not in classes:
                continue
            own, matrix = classes[k]
            for at in range(0, len(windows), 1 << 14):
                for w, c, cosine in like(windows[at : at + (1 << 14)], matrix):
                    d, i = int(np.searchsorted(rows, at + w, side="right")) - 1, own[c]
                    here, n = words[borders[d] : borders[d + 1]], len(items[i].words)
                    start = (at + w - int(rows[d])) * STEP
                    if start >= len(here):
                        continue
                    if n <= MOST:
                        share = _compare(items[i], here, start, start + k * STEP)
                    else:  # the pieces of a long item are found one by one; each quarter of its length is compared once
                        block = d, i, start // (n // 4)
                        if block not in seen:
                            seen[block] = _compare(items[i], here, start, start + k * STEP, n // 4)
                        share = seen[block]
                    if share:
                        yield d, i, cosine, share

    def hits(words: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for search in (at_every_step, at_every_word, verbatim):
            for d, i, cosine, share in search(words, borders):
                best[d, i] = max(best.get((d, i), (0.0, 0.0)), (share, cosine))
        for (d, i), (share, cosine) in best.items():
            yield d, shared.value[0][i].item_id, cosine, share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id").to_pylist(), b.column("text_key").to_pylist()
            for start in range(0, b.num_rows, 256):
                for at, words, borders in hashed_words(_texts(b.slice(start, 256)), BETWEEN):
                    found = [(ids[start + at + d], keys[start + at + d], item, c, s) for d, item, c, s in hits(words, borders)]
                    if found:
                        kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), kinds)], ["doc_id", "text_key", "item_id", "cosine", "lcs_share"])

    return map_arrow(docs, run, f"doc_id {kind}, text_key bigint, item_id bigint, cosine double, lcs_share double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, text_key: a row for each item that a document holds, in words or nearly so.

    The term statistics and the latent space cover all passages of all documents, the space all items too; every window of every document is then compared with the items (in blocks of ``ITEM_BLOCK``),
    and windows of cosine ``LEAST_COSINE`` or more go to the comparison by words: the longest common subsequence
    holds ``LEAST_LCS`` of the item's words, or ``LEAST_LCS_WITH_ANSWER`` of them where all words of its last
    sentence (its answer) are there too. Items of any length are found: those above ``MOST`` words by their pieces (the
    cosine is then that of a piece), those below ``SHORT`` also by windows at every word, and verbatim runs of ``ANCHOR``
    words lead to the comparison whatever their cosine. Windows are compared where they stand; nothing but hits leaves a task.

    Null texts count as empty and hold nothing; null and empty items match nothing; rows that repeat an id are
    told apart by text_key; empty tables give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, text_key bigint, item_id bigint, cosine double, lcs_share double"
    listed = benchmark.filter(F.col("item_id").isNotNull() & (F.trim(text_or_empty("text")) != ""))
    listed = listed.select(F.col("item_id").cast("long"), "text").distinct()
    count = listed.count()
    blocks = listed.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-2 * count // ITEM_BLOCK)))))
    frequency, passages = term_statistics(rows)
    idf = np.log((passages + 1) / (frequency + 1)) + 0.05
    corpus = corpus_sketch(rows, idf)
    out = spark.createDataFrame([], shape)
    for k in range(max(1, -(-2 * count // ITEM_BLOCK))):
        items = read_items(blocks.filter(F.col("block") == k).select("item_id", "text").orderBy("item_id", "text").collect())
        if items:
            out = out.unionByName(_scan(rows, items, fit_space(corpus, items, idf), kind))
    best = out.groupBy("doc_id", "text_key", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))
    return scratch.put(best, "contaminated")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    key, of, found_id = (free_name(docs, c) for c in ("text_key", "found_key", "found_id"))
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(found_id), F.col("text_key").alias(of)).distinct()
    marked = docs.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(of))
    return marked.join(found, same, "left_anti").select(*docs.columns)
