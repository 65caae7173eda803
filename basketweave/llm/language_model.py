"""A hierarchical Pitman-Yor language model of two words: Chinese restaurants seated by Gibbs sampling on Spark.

Every word u is the context of a restaurant whose customers are the words that follow it; all these restaurants share
one parent, whose customers are their tables. The parent's own base is continuous, so a table there serves a new word, and
what the parent keeps for new words is the probability of *any* unknown word. With discount d, strength s, customers
c, tables t and T tables in all:

    P(w | u) = (c_uw - d t_uw) / (s + c_u) + (s + d T_u) / (s + c_u) P(w)
    P(w) = (C_w - d' [C_w > 0]) / (s' + C),  P(unknown) = (s' + d' V) / (s' + C),  C_w = sum over u of t_uw

How the work is dealt out. Texts are cut into blocks, which keep their tokens as places in a list of their own words.
Counts, seatings and parents meet by exchanges of sorted key lists: a block or bucket sends what it holds, and gets totals
back in the order in which it asked, so neither texts nor single tokens are shuffled. Buckets hold whole contexts;
contexts of more than ``SPLIT`` tokens are dealt over several, and their tables are added up in the same exchange as the parents'.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, shared_dir
from .common import Scratch, map_arrow, ship_package, text_or_empty

#: Bytes of text in a block (a longer text is a block of its own), tokens and words for which one more bucket is made.
BLOCK_BYTES, BUCKET_TOKENS, BUCKET_WORDS = 12 << 20, 2_000_000, 1_000_000
#: Tokens for which a context is dealt over one more bucket.
SPLIT = 1 << 20
#: Customers up to which the seatings of a word are summed up exactly; above, they are taken by their saddle point.
EXACT = 64
#: Tables up to which that holds for many customers as well.
FEW = 8
#: Place of the text end in each block's list of words. It is also the context of a text's first word.
END = 0
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Params:
    """Strengths of contexts and parent; exchanges of seatings; sweeps in each; samples that the last exchange averages."""

    strength: float = 1.0
    root_strength: float = 1.0
    rounds: int = 2
    sweeps: int = 4
    samples: int = 2
    seed: int = 11


@dataclass(frozen=True)
class Discounts:
    """Discounts and strengths of the contexts and of their parent."""

    context: float
    strength: float
    root: float
    root_strength: float


# --- packed arrays ------------------------------------------------------------------------------------------


def pack(*arrays) -> bytes:
    """Arrays of integers, each in its narrowest type, compressed together."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x, np.int64)
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if low >= np.iinfo(k).min and high <= np.iinfo(k).max)
        parts.append(struct.pack("<2sQ", kind[1:].encode(), len(x)) + x.astype(kind).tobytes())
    raw = b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", blob)
    raw, at, out = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", 0, []
    while at < size:
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kind = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, kind, n, at + 10).astype(np.int64))
        at += 10 + n * kind.itemsize
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 62-bit values of integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) >> np.uint64(2)).astype(np.int64)


def _by_part(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by part and key, and (part, from, to) in that order."""
    order = np.lexsort((key, part))
    named, first = np.unique(part[order], return_index=True)
    return order, list(zip(named.tolist(), first.tolist(), np.append(first[1:], len(part)).tolist()))


# --- blocks -------------------------------------------------------------------------------------------------


class _Block:
    """Texts as places in a list of words; the first place is the text end."""

    def __init__(self):
        self.place = defaultdict(count().__next__)
        self.place[b""]  # no word is empty: the text end
        self.ids, self.held, self.sizes, self.tokens, self.bytes = [], [], [], [], 0

    def add(self, doc_id, held: bool, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
        own = np.fromiter(map(self.place.__getitem__, raw.split()), np.int32)
        self.tokens += [own, np.array([END], np.int32)]
        self.ids.append(doc_id)
        self.held.append(held)
        self.sizes.append(len(own) + 1)
        self.bytes += len(raw)

    def row(self, number: int) -> dict:
        from xxhash import xxh3_64_intdigest

        tokens = np.concatenate(self.tokens)
        trained = np.repeat(~np.array(self.held, bool), self.sizes)
        hashes = np.fromiter((xxh3_64_intdigest(w) >> 1 for w in self.place), np.int64, len(self.place))
        counts = np.bincount(tokens[trained], minlength=len(hashes))
        return {"block": number, "ids": self.ids, "held": self.held, "sizes": self.sizes, "tokens": pack(tokens), "words": pack(hashes, counts)}


BLOCK_COLUMNS = "held array<boolean>, sizes array<bigint>, tokens binary, words binary"


def _blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """block, ids, held, sizes (tokens of each text), tokens, words (64-bit names and training counts)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, numbers = None, count(TaskContext.get().partitionId() << 32)
        own = _Block()
        for b in batches:
            schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(b.schema.field("id").type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary())])
            for i, h, t in zip(b.column("id").to_pylist(), b.column("held").to_pylist(), b.column("text")):
                text = t.as_py()
                if own.ids and own.bytes + len(text) > block_bytes:
                    yield pa.RecordBatch.from_pylist([own.row(next(numbers))], schema=schema)
                    own = _Block()
                own.add(i, h, text)
        if own.ids:
            yield pa.RecordBatch.from_pylist([own.row(next(numbers))], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, f"block bigint, ids array<{kind.simpleString()}>, {BLOCK_COLUMNS}")


class _Grams:
    """The word pairs of a block in the order in which it asks the buckets for them."""

    def __init__(self, tokens: np.ndarray, trained: np.ndarray, ids: np.ndarray, counts: np.ndarray, buckets: int, split: int):
        n = np.int64(len(ids))
        before = np.concatenate(([END], tokens[:-1]))  # a text ends before the next begins
        code = before * n + tokens
        both = np.sort(code * 2 + trained)
        first = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        self.code, self.trained = both[first] >> 1, np.add.reduceat(both & 1, first) if len(first) else first
        u, w = np.divmod(self.code, n)
        parts = -(-counts[u] // split)
        bucket = mixed(ids[u] * 2 + 1 + mixed(mixed(ids[w]) % np.maximum(parts, 1))) % buckets
        self.order, self.buckets = _by_part(bucket, ids[u] * (int(ids.max()) + 1) + ids[w] if int(ids.max()) < 1 << 31 else u * n + w)
        self.u, self.w = ids[u][self.order], ids[w][self.order]
        self.at = np.empty(len(self.order), np.int64)
        self.at[self.order] = np.arange(len(self.order))
        self.token_code = code

    def token_places(self) -> np.ndarray:
        """For each token its pair's place in the order of asking."""
        return self.at[np.searchsorted(self.code, self.token_code)]


def _trained(row: dict) -> np.ndarray:
    return np.repeat(~np.array(row["held"], bool), row["sizes"])


# --- exchanges ----------------------------------------------------------------------------------------------

MESSAGE = "kind string, to bigint, sender bigint, a binary, b binary, ones bigint, twos bigint"
REPLY = "to bigint, part bigint, blob binary, known bigint, totals array<bigint>, ones bigint, twos bigint"


def _frame(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_MESSAGE = pa.schema([("kind", pa.string()), ("to", pa.int64()), ("sender", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64())])
_REPLY = pa.schema([("to", pa.int64()), ("part", pa.int64()), ("blob", pa.binary()), ("known", pa.int64()), ("totals", pa.list_(pa.int64())), ("ones", pa.int64()), ("twos", pa.int64())])


def _asks(kind: str, sender: int, keys: np.ndarray, values: list[np.ndarray], parts: int) -> list[dict]:
    """Messages that ask each part for the totals of ``keys``, to which they add ``values``."""
    order, found = _by_part(mixed(keys) % parts, keys)
    keys, values = keys[order], [v[order] for v in values]
    return [{"kind": kind, "to": p, "sender": sender, "a": pack(np.diff(keys[i:j], prepend=0)), "b": pack(*(v[i:j] for v in values))} for p, i, j in found]


def _totals(messages: DataFrame, words_are_even: bool) -> DataFrame:
    """Replies to all messages of kind ``ask``: their keys' ranks, the sum that they sent for words, and what all others
    sent for each key. ``give`` messages only add.

    The sums on one row of each part tell of its words (all keys, or the even ones): known (total > 0), the totals of
    each value, and how many have a total of one and two in the first value.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(unpack(r["a"])[0]) for r in rows]
        values = [unpack(r["b"]) for r in rows]
        named, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = max(map(len, values))
        totals = np.zeros((n, len(named)), np.int64)
        at = 0
        for k, v in zip(keys, values):
            for s, x in enumerate(v):  # keys of one message are distinct
                totals[s, where[at : at + len(k)]] += x
            at += len(k)
        of_words = totals[:, named % 2 == 0] if words_are_even else totals
        first = of_words[0]
        sums = {"known": int((first > 0).sum()), "totals": of_words.sum(axis=1).tolist(), "ones": int((first == 1).sum()), "twos": int((first == 2).sum())}
        out, at = [{"part": rows[0]["to"], **sums}], 0
        for r, k, v in zip(rows, keys, values):
            own, at = where[at : at + len(k)], at + len(k)
            if r["kind"] == "ask":
                sent = v[0][k % 2 == 0].sum() if words_are_even else v[0].sum()
                others = totals[:, own]
                others[: len(v)] -= np.stack(v)
                out.append({"to": r["sender"], "part": r["to"], "blob": pack(own, [sent], *others)})
        return _frame(out, _REPLY)

    ship_package(messages.sparkSession)
    return messages.groupBy("to").applyInArrow(run, REPLY)


def _sums(replies: DataFrame) -> tuple[int, int, int]:
    """Known words, and those with a total of one and two."""
    return tuple(x or 0 for x in replies.agg(*(F.sum(c) for c in ("known", "ones", "twos"))).first())


def _all(replies: DataFrame) -> list[int]:
    """The totals of all words, for each value."""
    by_value = replies.select(F.posexplode("totals").alias("value", "total")).groupBy("value").agg(F.sum("total").alias("total"))
    return [r["total"] for r in by_value.orderBy("value").collect()] or [0]


@dataclass
class _Received:
    """For each key: its rank in its part, the part, and the others' totals; and the sum that was sent for words."""

    rank: np.ndarray
    part: np.ndarray
    others: np.ndarray
    sent: int = 0


def _received(replies: list[dict], keys: np.ndarray, parts: int) -> _Received:
    order, found = _by_part(mixed(keys) % parts, keys)
    by_part = {r["part"]: unpack(r["blob"]) for r in replies}
    n = len(next(iter(by_part.values()))) - 2
    out = _Received(np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros((n, len(keys)), np.int64))
    for p, i, j in found:
        rank, sent, *others = by_part[p]
        out.sent += int(sent[0])
        out.rank[order[i:j]], out.part[order[i:j]], out.others[:, order[i:j]] = rank, p, np.stack(others)
    return out


class _Stored:
    """Tables bucketed by a key in the shared folder: what is grouped by that key reads them without an exchange."""

    def __init__(self, spark):
        self.spark, self.kept = spark, {}

    def put(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        name = f"lm_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/stage/{name}"
        df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, key).saveAsTable(name)
        self.kept[name] = path
        return self.spark.table(name)

    def drop(self) -> None:
        for name, path in self.kept.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_stage(self.spark, path)
        self.kept = {}


def _with(stored: DataFrame, key: str, messages: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship_package(stored.sparkSession)
    return stored.groupBy(key).cogroup(messages.groupBy("to")).applyInArrow(run, schema)


# --- restaurants --------------------------------------------------------------------------------------------


def log_seatings(discount: float, most: int = EXACT) -> np.ndarray:
    """log of the weight of all ways to seat c customers at t tables: generalised Stirling numbers, by c and t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            out[c + 1] = np.logaddexp(out[c] + np.log(np.maximum(c - discount * t, 1e-300)), np.concatenate(([-np.inf], out[c, :-1])))
            out[c + 1, 0] = -np.inf
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of x >= 1, by Stirling's series."""
    y = x + 2.0
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    return series - np.log(x * (x + 1.0))


class _ManyCustomers:
    """Table counts of words with many customers.

    seatings(c, t) is c! / (t! d^t) times the coefficient of z^c in (1 - (1 - z)^d)^t. Up to FEW tables the coefficient is
    summed up by the binomial series; above, it is taken at the saddle point and joined on at FEW.
    """

    def __init__(self, c: np.ndarray, others: np.ndarray, words: np.ndarray, tables: np.ndarray, discounts: Discounts):
        discount = discounts.context
        self.c, self.d, self.rest = c.astype(float), discount, discounts.strength / discount + others
        self.words, self.tables = words - discounts.root, discounts.root_strength + tables
        powers = np.zeros((FEW + 1, len(c)))  # coefficients of z^c in (1 - z)^(d j)
        for j in range(1, FEW + 1):
            if (discount * j) % 1:
                powers[j] = np.exp(_log_gamma(self.c - discount * j) - _log_gamma(self.c + 1)) / math.gamma(-discount * j)
        few = [sum((-1) ** j * math.comb(t, j) * powers[j] for j in range(1, t + 1)) for t in range(1, FEW + 1)]
        saddle = np.stack([self._saddle(np.full(len(c), float(t))) for t in range(1, FEW + 1)], axis=1)
        few = np.stack(few, axis=1)
        self.few = np.where(few > 0, np.log(np.maximum(few, 1e-300)), saddle)
        self.joint = self.few[:, -1] - saddle[:, -1]

    def _at(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For z = 1 - exp(-exp(u)): log z, log phi and psi = z phi' / phi with phi = 1 - (1 - z)^d."""
        y = -np.exp(u)
        z, phi = -np.expm1(y), -np.expm1(self.d * y)
        return np.log(z), np.log(phi), z * self.d * np.exp((self.d - 1) * y) / phi

    def _solve(self, too_high: Callable) -> np.ndarray:
        low, high = np.full(len(self.c), -21.0), np.full(len(self.c), 6.5)
        for _ in range(45):
            middle = (low + high) / 2
            over = too_high(middle)
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        return (low + high) / 2

    def _curvature(self, u: np.ndarray, psi: np.ndarray) -> np.ndarray:
        """z psi'(z)."""
        y = -np.exp(u)
        z = -np.expm1(y)
        return psi * (1 + z * (1 - self.d) * np.exp(-y) - psi)

    def _saddle(self, t: np.ndarray) -> np.ndarray:
        """log of the coefficient of z^c in phi^t."""
        u = self._solve(lambda u: self._at(u)[2] > self.c / t)
        log_z, log_phi, psi = self._at(u)
        return t * log_phi - self.c * log_z - 0.5 * np.log(2 * math.pi * np.maximum(t * self._curvature(u, psi), 1e-9))

    def log_chance(self, t: np.ndarray) -> np.ndarray:
        """log P(t | all else), up to what doesn't depend on t."""
        place = np.minimum(t, FEW).astype(np.int64) - 1
        ways = np.where(t <= FEW, self.few[np.arange(len(t)), place], self._saddle(t) + self.joint)
        return ways - _log_gamma(t + 1.0) + _log_gamma(self.rest + t) + _log_gamma(self.words + t) - _log_gamma(self.tables + t)

    def draw(self, rng, steps: int = 10) -> np.ndarray:
        """Metropolis steps from the mode with normal proposals around it."""
        def over(u: np.ndarray) -> np.ndarray:
            _, log_phi, psi = self._at(u)
            t = self.c / psi
            return log_phi + np.log((self.rest + t) * np.maximum(self.words + t, 1e-3) / (t * (self.tables + t))) > 0

        u = self._solve(over)
        _, _, psi = self._at(u)
        mode = np.clip(self.c / psi, 1.0, self.c - 1)
        bend = psi**2 / np.maximum(self._curvature(u, psi), 1e-12) / mode + 1 / mode - 1 / (self.rest + mode) - 1 / np.maximum(self.words + mode, 0.5) + 1 / (self.tables + mode)
        wide = np.maximum(1.0, 1.2 / np.sqrt(np.maximum(bend, 1e-12)))
        t = np.rint(mode)
        now = self.log_chance(t) + 0.5 * ((t - mode) / wide) ** 2
        for _ in range(steps):
            new = np.rint(rng.normal(mode, wide))
            fits = (new >= 1) & (new < self.c)
            new = np.where(fits, new, t)
            then = self.log_chance(new) + 0.5 * ((new - mode) / wide) ** 2
            taken = fits & (np.log(rng.random(len(t))) < then - now)
            t, now = np.where(taken, new, t), np.where(taken, then, now)
        return t.astype(np.int64)


def draw_tables(c: np.ndarray, others: np.ndarray, words: np.ndarray, tables: np.ndarray, discounts: Discounts, seatings: np.ndarray, rng) -> np.ndarray:
    """New table counts for (context, word) with ``c`` customers, beside ``others`` tables of the context and, in the parent,
    ``words`` tables of the word among ``tables`` of all.

    All customers of a word are seated anew in one draw from the conditional: P(t) is in proportion to seatings(c, t) times
    the factors s + d (others + k) of the context and (words - d' + k) / (s' + tables + k) of the parent, k = 0 ... t - 1.
    It is summed up to EXACT customers; ``_ManyCustomers`` makes Metropolis steps above.
    """
    t = np.ones(len(c), np.int64)
    d, s, root_d, root_s = discounts.context, discounts.strength, discounts.root, discounts.root_strength
    for n in np.unique(c[(c <= EXACT) & (c > 1)]).tolist():
        mine = np.flatnonzero(c == n)
        for rows in np.array_split(mine, max(1, len(mine) * n // 2_000_000)):
            k = np.arange(1, n)  # the first table is there whatever the draw
            own = (s + d * (others[rows, None] + k)) * (words[rows, None] - root_d + k) / (root_s + tables[rows, None] + k)
            chance = np.concatenate((np.zeros((len(rows), 1)), np.cumsum(np.log(own), axis=1)), axis=1) + seatings[n, 1 : n + 1]
            chance = np.cumsum(np.exp(chance - chance.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (chance < rng.random((len(rows), 1)) * chance[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    if len(rows):
        t[rows] = _ManyCustomers(c[rows], others[rows], words[rows], tables[rows], discounts).draw(rng)
    return t


class _Restaurants:
    """The pairs of a bucket, merged from what the blocks asked for."""

    def __init__(self, rows: list[dict]):
        self.senders = [r["sender"] for r in rows]
        u, w, n = [], [], []
        for r in rows:
            named, runs, words, counts = unpack(r["a"])
            u.append(np.repeat(np.cumsum(named), runs))
            w.append(words)
            n.append(counts)
        self.sizes = list(map(len, w))
        self.u, u_at = np.unique(np.concatenate(u), return_inverse=True)
        self.w, w_at = np.unique(np.concatenate(w), return_inverse=True)
        pairs, self.where = np.unique(u_at * np.int64(len(self.w)) + w_at, return_inverse=True)
        self.c = np.bincount(self.where, np.concatenate(n), len(pairs)).astype(np.int64)
        self.pu, self.pw = np.divmod(pairs, np.int64(len(self.w)))

    def keys(self) -> np.ndarray:
        """Even keys for words (as the parent's customers), odd ones for contexts (their tables)."""
        return np.concatenate((self.w * 2, self.u * 2 + 1))

    def values(self, t: np.ndarray) -> np.ndarray:
        by = lambda at, n: np.bincount(at, t, n).astype(np.int64)
        return np.concatenate((by(self.pw, len(self.w)), by(self.pu, len(self.u))))

    def sample(self, rest: np.ndarray, rest_tables: int, discounts: Discounts, sweeps: int, keep: int, rng) -> list[np.ndarray]:
        """Table counts after each of the last ``keep`` sweeps, beside the tables of all other buckets in the exchange before."""
        t = (self.c > 0).astype(np.int64)
        many = np.flatnonzero(self.c > 1)
        c, u, w = self.c[many], self.pu[many], self.pw[many]
        seatings, found = log_seatings(discounts.context), []
        for sweep in range(sweeps):
            now = rest + self.values(t)
            words, contexts = now[: len(self.w)], now[len(self.w) :]
            own = t[many]
            t[many] = draw_tables(c, contexts[u] - own, words[w] - own, rest_tables + t.sum() - own, discounts, seatings, rng)
            if sweep >= sweeps - keep:
                found.append(t.copy())
        return found


def _bucket_step(params: Params, round_: int, all_tables: int, discounts: Discounts, word_parts: int) -> Callable:
    """What a bucket does in a round: seat, then send its tables to the parents; in the last one answer the blocks as well."""
    last = round_ == params.rounds

    def run(stored: pa.Table, replies: pa.Table) -> pa.Table:
        rows = stored.to_pylist()
        if not rows:
            return _frame([], _MESSAGE)
        own, bucket = _Restaurants(rows), rows[0]["bucket"]
        keys = own.keys()
        samples = [(own.c > 0).astype(np.int64)]
        if round_:
            got = _received(replies.to_pylist(), keys, word_parts)
            rng = np.random.default_rng([params.seed, round_, bucket])
            samples = own.sample(got.others[0], all_tables - got.sent, discounts, params.sweeps, params.samples if last else 1, rng)
        out = _asks("give" if last else "ask", bucket, keys, [own.values(t) for t in samples], word_parts)
        if last:
            tables, at = np.sum(samples, axis=0), 0
            for sender, n in zip(own.senders, own.sizes):
                where, at = own.where[at : at + n], at + n
                out.append({"kind": "block", "to": sender, "sender": bucket, "a": pack(own.c[where], tables[where])})
        elif not round_:  # for the discount of the contexts
            out.append({"kind": "sums", "ones": int((own.c == 1).sum()), "twos": int((own.c == 2).sum())})
        return _frame(out, _MESSAGE)

    return run


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


# --- the operator -------------------------------------------------------------------------------------------


def held_out_tenth(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def score_texts(
    docs: DataFrame, held_out: Column, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS, bucket_words: int = BUCKET_WORDS, split: int = SPLIT,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are what stands between white space (space, U+0009 to U+000D), A-Z lower-cased, and one text end; a null text is
    empty and has that one. The model learns from all rows where ``held_out`` is false and scores all rows, whole texts. ``score``
    is the log10 probability averaged over the sampled seatings, word by word; ``perplexity`` is 10^(-score / n_tokens).
    ``base_score`` is that of single words with 0.1 added to each count. Words are named by 64 bits. Rows that repeat an id are
    texts of their own; without training rows all scores are 0; an empty table gives no rows. Other columns are ignored.
    """
    spark, scratch, stored = docs.sparkSession, Scratch(docs.sparkSession), _Stored(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    files = max(8, 2 * docs.rdd.getNumPartitions())  # so that what a task reads doesn't grow with the table
    blocks = stored.put(_blocks(docs, held_out, id_col, text_col, block_bytes), "block", files)
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets, parts = 1 + tokens // bucket_tokens, 1 + tokens // (8 * bucket_words)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                hashes, counts = unpack(r["words"])
                yield from _frame(_asks("ask", r["block"], hashes, [counts], parts), _MESSAGE).to_batches()

    words = scratch.put(_totals(map_arrow(blocks.select("block", "words"), ask_words, MESSAGE), False), "lm-words")
    known, train_tokens = _sums(words)[0], _all(words)[0]
    words = words.filter("to IS NOT NULL")

    def word_ids(row: dict, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Dense ids and training counts of a block's words."""
        hashes, own = unpack(row["words"])
        got = _received(replies, hashes, parts)
        return got.rank * parts + got.part, got.others[0] + own

    def ask_pairs(stored: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in stored.to_pylist():
            ids, counts = word_ids(row, replies.to_pylist())
            own = _Grams(unpack(row["tokens"])[0], _trained(row), ids, counts, buckets, split)
            trained = own.trained[own.order]
            for p, i, j in own.buckets:
                first = np.flatnonzero(np.diff(own.u[i:j], prepend=-1))
                runs = np.diff(first, append=j - i)
                out.append({"bucket": p, "sender": row["block"], "a": pack(np.diff(own.u[i:j][first], prepend=0), runs, own.w[i:j], trained[i:j])})
        return _frame(out, pa.schema([("bucket", pa.int64()), ("sender", pa.int64()), ("a", pa.binary())]))

    pairs = _with(blocks, "block", words, ask_pairs, "bucket bigint, sender bigint, a binary")
    pairs = stored.put(pairs.repartition(buckets, "bucket"), "bucket", buckets)
    replies, all_tables, discount, root_discount = spark.createDataFrame([], REPLY), 0, 0.5, 0.5
    for round_ in range(params.rounds + 1):
        discounts = Discounts(discount, params.strength, root_discount, params.root_strength)
        step = _bucket_step(params, round_, all_tables, discounts, parts)
        sent = scratch.put(_with(pairs, "bucket", replies, step, MESSAGE), f"lm-sent-{round_}")
        if not round_:
            discount = _discount(*(x or 0 for x in sent.filter("kind = 'sums'").agg(F.sum("ones"), F.sum("twos")).first()))
        if round_ < params.rounds:
            if round_:
                scratch.drop(f"lm-replies-{round_ - 1}")
            replies = scratch.put(_totals(sent.filter("kind = 'ask'"), True), f"lm-replies-{round_}")
            all_tables = _all(replies)[0]
            root_discount = _discount(*_sums(replies)[1:])
            replies = replies.filter("to IS NOT NULL")
            scratch.drop(f"lm-sent-{round_}")

    def ask_parents(stored: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in stored.select(["block", "words"]).to_pylist():
            ids, _ = word_ids(row, replies.to_pylist())
            keys = np.concatenate((ids * 2, ids * 2 + 1))
            out += _asks("ask", row["block"], keys, [np.zeros(len(keys), np.int64)], parts)
        return _frame(out, _MESSAGE)

    asked = _with(blocks, "block", words, ask_parents, MESSAGE)
    parents = scratch.put(_totals(asked.unionByName(sent.filter("kind = 'give'")), True), "lm-parents")
    answers = (
        words.select(F.lit("word").alias("kind"), "to", "part", "blob")
        .unionByName(parents.filter("to IS NOT NULL").select(F.lit("parent").alias("kind"), "to", "part", "blob"))
        .unionByName(sent.filter("kind = 'block'").select(F.lit("pair").alias("kind"), "to", F.col("sender").alias("part"), F.col("a").alias("blob")))
    )
    score = _scorer(params, word_ids, parts, buckets, split, known, train_tokens, _all(parents), discount, root_discount)
    columns = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    scored = scratch.put(_with(blocks, "block", answers, score, f"doc_id {kind}, held_out boolean, {columns}"), "lm-scored")
    scratch.drop("lm-words", "lm-parents", f"lm-sent-{params.rounds}", *([f"lm-replies-{params.rounds - 1}"] if params.rounds else []))
    stored.drop()
    return scored


def _scorer(params: Params, word_ids: Callable, parts: int, buckets: int, split: int, known: int, train_tokens: int, all_tables: list[int], discount: float, root_discount: float) -> Callable:
    def run(stored: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        replies = replies.to_pylist()
        by_kind = {k: [r for r in replies if r["kind"] == k] for k in ("word", "parent", "pair")}
        for place, row in enumerate(stored.to_pylist()):
            ids, counts = word_ids(row, by_kind["word"])
            tokens, sizes = unpack(row["tokens"])[0], np.array(row["sizes"])
            own = _Grams(tokens, _trained(row), ids, counts, buckets, split)
            answers = {r["part"]: unpack(r["blob"]) for r in by_kind["pair"]}
            c, tables = (np.concatenate([answers[p][k] for p, _, _ in own.buckets]) for k in (0, 1))
            totals = _received(by_kind["parent"], np.concatenate((ids * 2, ids * 2 + 1)), parts).others
            as_word, as_context = totals[:, : len(ids)], totals[:, len(ids) :]
            whole = params.root_strength + np.array(all_tables)[:, None]
            unknown = (params.root_strength + root_discount * known) / whole
            parent = np.where(counts > 0, np.maximum(as_word - root_discount, 0.0) / whole, unknown)
            backing = (params.strength + discount * as_context) / (params.strength + counts)
            at, before = own.token_places(), np.concatenate(([END], tokens[:-1]))
            chance = np.maximum(c[at] - discount * tables[at] / len(totals), 0.0) / (params.strength + counts[before])
            del own, answers, at, c, tables
            for s in range(len(totals)):
                chance += backing[s][before] * parent[s][tokens] / len(totals)
            base = np.log10((counts + 0.1) / (train_tokens + 0.1 * (known + 1)))[tokens]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            score = np.add.reduceat(np.log10(chance), starts)
            columns = [sizes, np.add.reduceat((counts > 0).astype(np.int64)[tokens], starts), np.full(len(sizes), train_tokens), np.add.reduceat(base, starts), score, 10 ** (-score / sizes)]
            ids_held = (stored.column(n).slice(place, 1).combine_chunks().flatten() for n in ("ids", "held"))
            out.append(pa.Table.from_arrays([*ids_held, *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]))
        if out:
            return pa.concat_tables(out)
        kind = stored.schema.field("ids").type.value_type
        return pa.schema([("doc_id", kind), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), *((n, pa.float64()) for n in ("base_score", "score", "perplexity"))]).empty_table()

    return run
