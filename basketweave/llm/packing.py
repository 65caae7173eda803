"""Packing token sequences so that each window holds the target mixture of sources."""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import worker_value
from .common import Scratch, map_arrow, text_or_empty

WINDOW = 2048
END_ID = 1
#: Queues the schedule tells apart; further, smaller sources share one queue.
MOST_QUEUES = 1024
REST = "\0rest"


class Encoder:
    """Token ids of whole texts as little-endian bytes; ``ranks_path`` names the same vocabulary as ranks, which encodes faster."""

    def __init__(self, json_path: str, ranks_path: str | None):
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(json_path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = "I" if max(self.tokenizer.get_vocab_size(with_added_tokens=True), END_ID) > 65_536 else "H"
        self.plain = self._library
        if ranks_path:
            import public_tokenizers

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.plain = own.encode_ordinary

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, then END_ID. Texts with special strings go to the library, which knows them."""
        out = []
        for t in texts:
            ids = self._library(t) if any(s in t for s in self.specials) else self.plain(t)
            ids.append(END_ID)
            out.append(array(self.wide, ids).tobytes())
        return out


def encode_docs(docs: DataFrame, json_path: str, ranks_path: str | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, n, ids, part (task), start (tokens of the source before it in that task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value(("encoder", json_path, ranks_path), lambda: Encoder(json_path, ranks_path))
        part, used = TaskContext.get().partitionId(), {}
        size = array(encoder.wide).itemsize
        for b in batches:
            sources = b.column("source").to_pylist()
            ids = encoder.encode(b.column("text").to_pylist())
            n, start = [len(x) // size for x in ids], []
            for s, k in zip(sources, n):
                start.append(used.get(s, 0))
                used[s] = start[-1] + k
            columns = [b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(n), pa.int64()), pa.array(start, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n", "ids", "part", "start"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, source string, n bigint, ids binary, part bigint, start bigint")


class Mixture:
    """Deficit round-robin over the queues in closed form, so that any task can take it up at any window.

    Token i of a queue with weight w is due at (2 i + 1) / (2 w); the windows take the tokens in the order in
    which they are due (ties: by queue). After any number of windows each queue is thus served to within about a
    token of its share, what it lacks is carried to the next window, and when a queue is empty the others share
    its slots by their weights. Which tokens a window takes depends on this order alone, not on how it is found.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW):
        self.totals, self.weights, self.window = totals, weights, window
        self.total = sum(totals)
        self.full = self.total // window
        # The tail is cut at powers of two, which need no padding.
        self.tail = [self.full * window]
        while self.tail[-1] < self.total:
            self.tail.append(self.tail[-1] + (1 << ((self.total - self.tail[-1]).bit_length() - 1)))
        self.windows = self.full + len(self.tail) - 1
        # When queues end: (slots used by then, time, weight of the queues that go on).
        self.phases, weight, clock, used = [(0.0, 0.0, float(sum(weights)))], sum(weights), 0.0, 0.0
        for end, w in sorted((t / w, w) for t, w in zip(totals, weights)):
            used, clock, weight = used + weight * (end - clock), end, weight - w
            self.phases.append((used, clock, float(weight)))
        self.made: OrderedDict[int, tuple[list[int], list[int]]] = OrderedDict()

    def slots_before(self, k: int) -> int:
        return k * self.window if k <= self.full else self.tail[k - self.full]

    def _served(self, slots: int) -> list[int]:
        """Tokens of each queue among the first ``slots`` in due order: surely fewer at first, then one by one."""
        if slots >= self.total:
            return list(self.totals)
        used, clock, weight = self.phases[max(0, bisect.bisect_right(self.phases, (float(slots), float("inf"), 0.0)) - 1)]
        if weight > 0:
            clock += max(0.0, slots - used) / weight
        queues, got, heap = len(self.totals), [], []
        for i, (t, w) in enumerate(zip(self.totals, self.weights)):
            unsure = 2 + queues * w / weight if weight > 0 else t
            g = max(0, min(t, int(w * clock + 0.5 - unsure)))
            got.append(g)
            if g < t:
                heap.append(((2 * g + 1) / (2 * w), i))
        heapq.heapify(heap)
        for _ in range(slots - sum(got)):
            i = heap[0][1]
            got[i] += 1
            if got[i] < self.totals[i]:
                heapq.heapreplace(heap, ((2 * got[i] + 1) / (2 * self.weights[i]), i))
            else:
                heapq.heappop(heap)
        return got

    def before(self, k: int) -> tuple[list[int], list[int]]:
        """Tokens of each queue in the first k windows, and their running sums over the queues before."""
        if k not in self.made:
            got = self._served(self.slots_before(k))
            self.made[k] = got, [0, *itertools.accumulate(got)]
            if len(self.made) > 4096:
                self.made.popitem(last=False)
        return self.made[k]

    def window_of(self, queue: int, token: int) -> int:
        """The window that takes a token of a queue."""
        low, high = 0, self.windows
        while high - low > 1:
            mid = (low + high) // 2
            if self.before(mid)[0][queue] <= token:
                low = mid
            else:
                high = mid
        return low

    def pieces(self, queue: int, first: int, n: int, near: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset in it, start in the document, length) of a document's tokens first, ..., first + n - 1.

        ``near`` is the window where the search begins, that of the document before as a rule.
        """
        k, done = near, 0
        served, sums = self.before(k)
        then, after = self.before(k + 1)
        if served[queue] > first or first - then[queue] > self.window:
            k = self.window_of(queue, first)
            served, sums = self.before(k)
            then, after = self.before(k + 1)
        while done < n:
            while then[queue] <= first + done:
                k += 1
                served, sums = then, after
                then, after = self.before(k + 1)
            length = min(n - done, then[queue] - first - done)
            yield k, after[queue] - sums[queue] + first + done - served[queue], done, length
            done += length


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    targets: dict[str, int] | None = None,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is its token ids and then END_ID; each id lies in exactly one piece. Sequences hold ``window``
    tokens without gaps; what is left at the end is cut into sequences of powers of two, so nothing is padded.
    Every sequence takes its tokens from the sources in proportion to ``targets`` (source: weight; others weigh
    nothing less than 1), by default to the tokens that they hold, so that all end together.

    The ids are written once. Each row knows the tokens of its source before it in its task, a small table adds
    those of earlier tasks, and the schedule is a function of the token's number: no task waits for another and
    a source that holds most rows is cut like any other. The window over tasks has one row per source and task.
    Null texts count as empty (one piece, END_ID), null sources as ''; rows that repeat an id are documents of
    their own; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(encode_docs(docs, json_path, ranks_path, id_col, text_col, source_col), "encoded")
    sums = scratch.put(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "encoded-sums")
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(MOST_QUEUES).collect()
    named = [r["source"] for r in largest]
    queue = F.col("source") if len(named) < MOST_QUEUES else F.when(F.col("source").isin(named[:-1]), F.col("source")).otherwise(F.lit(REST))
    sums = sums.withColumn("queue", queue)
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    counts = [totals[q] for q in names]
    weights = [max(1, int(targets.get(q, 1))) for q in names] if targets else list(counts)
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.join(bases, ["source", "part"]).select("doc_id", "source", "queue", "ids", "n", (F.col("base") + F.col("start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        mixture, place, near = Mixture(counts, weights, window), {q: i for i, q in enumerate(names)}, {}
        for b in batches:
            found, crcs, row = [], [], []
            for r, (name, ids, n, first) in enumerate(zip(*(b.column(c).to_pylist() for c in ("queue", "ids", "n", "first")))):
                wide = memoryview(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes())
                q = place[name]
                own = list(mixture.pieces(q, first, n, near.get(q, 0)))
                near[q] = own[-1][0]
                found += own
                crcs += [zlib.crc32(wide[4 * start : 4 * (start + length)]) for _, _, start, length in own]
                row += [r] * len(own)
            window_id, offset, start, length = (pa.array(v, pa.int64()) for v in np.array(found, np.int64).reshape(-1, 4).T)
            doc, n, source = (b.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "n", "source"))
            columns = [doc, start, length, pa.array(crcs, pa.int64()), n, window_id, offset, source]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(placed, run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string")
