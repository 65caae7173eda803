"""Ranked lexical search of many items at once, on partial sums that the items share."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, text_or_empty

#: Items and term occurrences that one scan of the documents serves; more items take more scans.
BLOCK_ITEMS, BLOCK_TERMS = 1_024, 200_000
#: Documents whose accumulators are held together.
DOCS = 1_024
#: Operands of an item that are tried in pairs, in order of their support. A bound on planning: results don't depend on it.
PAIRED = 96

# Fixed values of the score: scale of weights and of saturation, its constants, and the share of the length.
WEIGHT_SCALE, TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 75


def _term_bytes() -> bytes:
    """ASCII letters and digits (letters small) and all bytes of other characters stay; the rest becomes a space."""
    keep = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in range(128):
        if chr(c).isalnum():
            keep[c] = ord(chr(c).lower())
    return bytes(keep)


TERM_BYTES = _term_bytes()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


@dataclass
class Plan:
    """Sums in the order in which they are worked out.

    Operand k < ``leaves`` is the weighted contribution of (term, repeats) ``leaf_terms[k]``; operand
    ``leaves + j`` is the sum of the two operands ``joins[j]``. An item's score is the sum of its operands.
    """

    leaf_terms: list[tuple[int, int]]
    joins: list[tuple[int, int]]
    items: list[list[int]]

    @property
    def leaves(self) -> int:
        return len(self.leaf_terms)

    def additions(self) -> int:
        return len(self.joins) + sum(max(0, len(x) - 1) for x in self.items)


def share(item_terms: list[dict[int, int]]) -> Plan:
    """Mine term sets that several items share: the pair of operands that most items hold becomes one operand, and so on.

    Pairs of pairs are operands as well, so larger shared sets grow from smaller ones, and the result is a DAG in
    which every partial sum is worked out once for each document, however many items use it.
    """
    leaves: dict[tuple[int, int], int] = {}
    items = [{leaves.setdefault(tn, len(leaves)) for tn in sorted(x.items())} for x in item_terms]
    joins: list[tuple[int, int]] = []
    while True:
        support = Counter(k for x in items for k in x)
        pairs: Counter = Counter()
        for x in items:
            common = sorted((k for k in x if support[k] > 1), key=lambda k: (-support[k], k))[:PAIRED]
            pairs.update(combinations(sorted(common), 2))
        used: set[int] = set()
        chosen = []
        for (a, b), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if n < 2:
                break
            if a not in used and b not in used:  # counts of pairs that overlap a chosen one are stale
                used |= {a, b}
                chosen.append((a, b))
        if not chosen:
            return Plan(list(leaves), joins, [sorted(x) for x in items])
        holders = defaultdict(list)
        for i, x in enumerate(items):
            for k in x:
                holders[k].append(i)
        for a, b in chosen:
            new = len(leaves) + len(joins)
            joins.append((a, b))
            for i in holders[a]:
                if b in items[i]:
                    items[i] -= {a, b}
                    items[i].add(new)


class Accumulators:
    """Scores of a few documents for all items of a plan."""

    def __init__(self, plan: Plan, weights: list[int]):
        self.plan, self.weights = plan, weights
        self.left = Counter(k for j in plan.joins for k in j)
        self.left.update(k for x in plan.items for k in x)

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, score of each document) from the postings; items that no document scores for are left out."""
        order = np.argsort(term, kind="stable")
        doc, value = doc[order], value[order]
        named, first = np.unique(term[order], return_index=True)
        ends = np.append(first[1:], len(doc))
        place = dict(zip(named.tolist(), zip(first.tolist(), ends.tolist())))
        made: dict[int, np.ndarray | None] = {}
        left = dict(self.left)
        leaves, joins = self.plan.leaf_terms, self.plan.joins

        def take(k: int) -> np.ndarray | None:
            if k < len(leaves):  # leaves are cheap to make and not kept
                t, repeats = leaves[k]
                if t not in place or not self.weights[t]:
                    return None
                a, b = place[t]
                out = np.zeros(n_docs, np.int64)
                out[doc[a:b]] = value[a:b] * (self.weights[t] * repeats)
                return out
            left[k] -= 1
            return made[k] if left[k] else made.pop(k)

        def add(x, y):
            return y if x is None else x if y is None else x + y

        for j, (a, b) in enumerate(joins):
            made[len(leaves) + j] = add(take(a), take(b))
        for i, operands in enumerate(self.plan.items):
            total = None
            for k in operands:
                total = add(total, take(k))
            if total is not None:
                yield i, total


def _postings(docs: DataFrame, terms_held: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the text), terms, tfs (those that items hold) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms_held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for b in batches:
            n, per_doc, found = [], [], []
            for text in b.column("text"):
                own = terms(text.as_py())
                n.append(len(own))
                keys, counts = np.unique(np.fromiter((k for k in map(place, own) if k is not None), np.int64), return_counts=True)
                per_doc.append(len(keys))
                found.append((keys, counts))
            offsets = pa.array(np.concatenate(([0], np.cumsum(per_doc))), pa.int32())
            column = lambda k: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), column(0), column(1)], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>").filter("n > 0")


def weight(df: int, n_docs: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _best(postings: DataFrame, plan: Plan, weights: list[int], n_docs: int, n_terms: int, top: int, together: int) -> DataFrame:
    """item (place in the plan), doc_id, score: the ``top`` best documents of each task."""
    shared = postings.sparkSession.sparkContext.broadcast((plan, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Accumulators(*shared.value)
        best: dict[int, list[tuple]] = defaultdict(list)  # (-score, id is null, id)
        kind = pa.null()
        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for at in range(0, whole.num_rows, together):
                b = whole.slice(at, together)
                ids = b.column("doc_id").to_pylist()
                held, tf = b.column("terms"), b.column("tfs").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.diff(held.offsets.to_numpy()))
                # Python integers: the product may pass 64 bits on its way.
                length = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
                value = TF_SCALE * tf // (TF_UNIT * tf + LENGTH_UNIT * length[doc])
                for i, score in own.scores(len(ids), doc, held.flatten().to_numpy(), value):
                    least = -best[i][-1][0] if len(best[i]) == top else 1
                    if len(score) > top:
                        least = max(least, int(np.partition(score, len(score) - top)[len(score) - top]))
                    new = [(-int(score[k]), ids[k] is None, ids[k]) for k in np.flatnonzero(score >= max(1, least)).tolist()]
                    if new:
                        best[i] = heapq.nsmallest(top, best[i] + new)
        found = [(i, d, -s) for i, rows in best.items() for s, _, d in rows]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    kind = postings.schema["doc_id"].dataType.simpleString()
    return map_arrow(postings, run, f"item int, doc_id {kind}, score bigint")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(item id, counted terms) in blocks of bounded size. Wholly repeated rows count once; texts of one id are joined."""
    rows = items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")).distinct().orderBy("item_id", "text")
    block: list[tuple] = []
    size = 0
    for r in rows.toLocalIterator():
        own = Counter(terms(r["text"]))
        if block and block[-1][0] == r["item_id"]:
            block[-1][1].update(own)
        else:
            if block and (len(block) == BLOCK_ITEMS or size + len(own) > BLOCK_TERMS):
                yield block
                block, size = [], 0
            block.append((r["item_id"], own))
        size += len(own)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", together: int = DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item with the highest score above 0.

    The documents are read once for each block of items: one pass cuts them into terms and keeps those that items hold,
    document counts follow from the kept postings, and a second pass over the postings works out all items at once on
    the sums that ``share`` found. A task returns at most ``top`` documents for each item, and a window with a group limit
    picks among them.

    A null text has no term; documents without a term count nowhere. Equal scores go by id, null ids last. Rows
    that repeat a document are ranked each; wholly repeated item rows count once, and texts of one item id are one item.
    Items without terms and empty tables give no rows. Other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    item_type = items.schema[item_col].dataType.simpleString()
    doc_type = docs.schema[id_col].dataType.simpleString()
    for block in _blocks(items, item_col, text_col):
        scratch = Scratch(spark)
        held: dict[bytes, int] = {}
        plan = share([{held.setdefault(t, len(held)): n for t, n in own.items()} for _, own in block])
        if not held:
            continue
        postings = scratch.put(_postings(docs, held, id_col, text_col), "ranking-postings")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = [0] * len(held)  # at most the terms of a block of items
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        found = scratch.put(_best(postings, plan, [weight(x, n_docs) for x in df], n_docs, n_terms, top, together), "ranking-best")
        scratch.drop("ranking-postings")
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {item_type}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        ranked = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score bigint") if out is None else out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANK_SQL = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
    row_number() OVER () AS r FROM documents),
sized AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM cut WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM sized),
wanted AS (
  SELECT item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT DISTINCT item_id, text FROM benchmark
  ), unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term)
  GROUP BY item_id, term),
held AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), totals),
parts AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // all_terms)))) AS v
  FROM held JOIN sized USING (r) JOIN weights USING (term), totals),
scored AS (SELECT item_id, r, sum(repeats * v)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0)
WHERE rank <= 10
"""
