"""Token counts of whole texts by a two-tier lookup of chunk lengths, without shuffling chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache, worker_value
from .common import map_arrow, text_or_empty

#: Chunks in the broadcast table: its bound, whatever the input.
TABLE_CHUNKS = 65_536
#: Candidates for the table that each partition names, and the most it counts at a time.
PARTITION_CHUNKS, PARTITION_COUNTED = 8_192, 400_000
#: Texts handled together.
TEXTS = 256
#: White space other than what both Python and the tokenizer split at; such texts are encoded whole.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_value(("tokenizer", path), lambda: Tokenizer.from_file(path))


def _lengths(tokenizer, chunks: list[str]) -> list[int]:
    """Tokens of each chunk, encoded many at once; tokens are told apart by where they start."""
    import numpy as np

    out: list[int] = []
    for at in range(0, len(chunks), 2048):
        some = chunks[at : at + 2048]
        starts = np.cumsum([0] + [len(c) + 1 for c in some[:-1]])
        offsets = tokenizer.encode(" ".join(some), add_special_tokens=False).offsets
        owner = np.searchsorted(starts, [a for a, _ in offsets], side="right") - 1
        out += np.bincount(owner, minlength=len(some)).tolist()
    return out


def _specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def count_texts(texts: list[str], tokenizer, cache: ChunkCache) -> list[int]:
    """Tokens of each text. A text with a special string or odd white space goes to the tokenizer whole."""
    specials, out = _specials(tokenizer), [0] * len(texts)
    for at in range(0, len(texts), TEXTS):
        split, seen = {}, set()
        for i in range(at, min(at + TEXTS, len(texts))):
            t = texts[i]
            if any(s in t or s in t.lower() for s in specials if s[:2] in t) or ODD_SPACE.search(t):
                out[i] = len(tokenizer.encode(t, add_special_tokens=False).ids)
            else:
                split[i] = t.split()
                seen.update(split[i])
        known = cache.lookup(seen).__getitem__
        for i, chunks in split.items():
            out[i] = sum(map(known, chunks))
    return out


def frequent_chunks(docs: DataFrame, text_col: str = "text", most: int = TABLE_CHUNKS, per_partition: int = PARTITION_CHUNKS) -> dict[str, int]:
    """The most frequent chunks over all rows with their counts.

    Each partition counts its chunks with bounded memory (rare ones are forgotten now and then) and names its
    ``per_partition`` most frequent; the sums of these decide. Only these candidates are shuffled, and the
    ``most`` rows that reach the driver are a fixed bound. What is missed here costs time, never tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(t.split())
                if len(counts) > PARTITION_COUNTED:
                    counts = Counter(dict(counts.most_common(PARTITION_COUNTED // 4)))
        top = [(c, n) for c, n in counts.most_common(per_partition) if len(c) <= 64]
        yield pa.RecordBatch.from_pydict({"chunk": [c for c, _ in top], "n": [n for _, n in top]}, schema=pa.schema([("chunk", pa.string()), ("n", pa.int64())]))

    named = map_arrow(docs.select(text_or_empty(text_col).alias("text")), count, "chunk string, n bigint")
    total = named.groupBy("chunk").agg(F.sum("n").alias("n"))
    return {r["chunk"]: r["n"] for r in total.orderBy(F.desc("n"), "chunk").limit(most).collect()}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = TABLE_CHUNKS
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the whole text, without added special tokens; special
    strings inside a text are handled as the library does by default. Texts are cut at white space, which no
    token crosses. The lengths of the most frequent chunks are broadcast; each worker encodes the chunks it
    has not met and keeps their lengths in a bounded cache. No text and no chunk is shuffled. A null text
    counts as empty (0 tokens), ids pass through unchanged, an empty table gives no rows.
    """
    tokenizer = _tokenizer(tokenizer_path)
    frequent = list(frequent_chunks(docs, text_col, table_chunks))
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, _lengths(tokenizer, frequent))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer_path)
        cache = worker_value(("lengths", tokenizer_path), lambda: ChunkCache(lambda c: _lengths(own, c)))
        cache.table = table.value
        for b in batches:
            text = b.column("text")
            n = pa.array(count_texts(text.to_pylist(), own, cache), pa.int64())
            n_bytes = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
