"""Toxicity of texts: disguised words are decoded under a character language model, then words are scored."""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, map_arrow, text_or_empty

#: Labelled rows that the word weights are learned from, taken in hash order of their id. Also the bound of the broadcast.
TRAIN_ROWS = 20_000
#: Features that may carry a weight, and the evidence (likelihood ratio, toxic documents) that each must have.
MOST_FEATURES, LEAST_G, LEAST_DOCS = 512, 20.0, 3
#: Beginnings of words that are features beside the words themselves, and the most that a feature counts in a text.
PREFIXES, MOST_COUNTED = range(3, 8), 5
REGULARISATION = 1e-4
#: Symbols of the language model: 0 stands between words, 1 to 26 for letters; contexts of three symbols.
BITS, ORDER = 5, 4
#: Decoded tokens, words or pieces that a worker keeps of each, and the longest piece that is kept.
HELD, LONGEST_HELD = 100_000, 64
#: Rows that a worker holds as Python texts at a time.
ROWS = 256

# Accented Latin-1 small letters by their base letters, and what signs may stand for.
ACCENTS = dict(zip("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿß", "aaaaaaceeeeiiiinoooooouuuuyys"))
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
WILD = "*"
# Costs of the noisy channel, in nats.
SIGN_COST, DROP_COST, WILD_COST, RUN_COST, PAIR_COST, JOIN_COST, SPLIT_COST = 1.0, 3.0, 3.0, 0.5, 9.0, 0.2, 1.5
BEAM = 48


def _tables() -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
    """By Latin-1 byte of lower-case text: symbol; class (1 letter, 2 sign); letters, all else a space; folded letters, all else as it is."""
    symbol, kind = np.zeros(256, np.int64), np.zeros(256, np.uint8)
    words, base = bytearray(b" " * 256), bytearray(range(256))
    for c in range(256):
        letter = ACCENTS.get(chr(c), chr(c))
        if "a" <= letter <= "z":
            symbol[c], kind[c], words[c], base[c] = ord(letter) - 96, 1, c, ord(letter)
        elif chr(c) in LEET or chr(c) == WILD:
            kind[c] = 2
        elif chr(c).isalpha():
            words[c] = c
    return symbol, kind, bytes(words), bytes(base)


SYMBOL, KIND, TO_WORDS, TO_BASE = _tables()
SIGNS = re.escape("".join(LEET) + WILD)
SIGNED = re.compile(rf"[a-z]++[{SIGNS}][a-z{SIGNS}]*|[{SIGNS}]++[a-z][a-z{SIGNS}]*")
REPEATED = re.compile(r"(?<![a-z])[a-z]*?([a-z])\1\1[a-z]*")
#: What a piece needs for a match of either.
DISGUISED = re.compile(rf"[{SIGNS}]|([a-z])\1\1".encode())
SPACED = re.compile(rf"(?<![a-z{SIGNS}])[a-z{SIGNS}](?:[\s._\-/]+[a-z{SIGNS}]){{2,}}(?![a-z{SIGNS}])")
TRAIL = re.compile(r"([!*$+|@])\1+$")


# Letters that look like a-z, Latin letters that have no decomposition, and scripts without spaces.
ALIKE = str.maketrans("авсԁеɡһіјкӏмոорԛгѕтυѵԝхуᴢαβεικνορτχωγ", "abcdeghijklmnopqrstuvwxyzabeikvoptxwy")
PLAIN = str.maketrans({"ł": "l", "đ": "d", "ı": "i", "œ": "oe", "ħ": "h", "ŧ": "t", "ŋ": "n", "ſ": "s", "ɑ": "a", "’": "'", "‘": "'"})
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


@lru_cache(1)
def _word() -> re.Pattern:
    """Letters and the marks on them, in a row."""
    marks = "".join(map(re.escape, filter(lambda c: unicodedata.category(c)[0] == "M", map(chr, range(0x300, 0x1F000)))))
    return re.compile(rf"[^\W\d_](?:[^\W\d_]|[{marks}])*")


def composed(text: str) -> str:
    """Small letters in their compatibility forms, without characters that don't show."""
    return HIDDEN.sub("", unicodedata.normalize("NFKC", HIDDEN.sub("", text).lower()).lower())


def _alike(text: str) -> str:
    """``text`` with letters that look like a-z as these: in words with Latin letters, or anywhere in a text of mostly Latin ones."""
    mostly = 2 * sum("a" <= c <= "z" for c in text) >= sum(map(str.isalpha, text))

    def one(m: re.Match) -> str:
        folded = m[0].translate(ALIKE)
        return folded if mostly and folded.isascii() or re.search("[a-z]", m[0]) else m[0]

    return _word().sub(one, text)


def latin(text: str) -> bytes:
    """Small letters in Latin-1, for the language model and the lattice: other Latin letters by their base, all else as '?'."""
    small = text.lower()
    try:
        return small.encode("latin-1")
    except UnicodeEncodeError:
        pass
    folded = _alike(composed(text)).translate(PLAIN)
    bare = "".join(c if c < "\u0100" else unicodedata.normalize("NFD", c)[0] for c in folded)
    return bare.encode("latin-1", "replace")


def all_words(text: str) -> list[bytes]:
    """The words of the text in small letters (UTF-8), of any script; pairs of characters where a script has no spaces."""
    small = text.lower()
    try:
        return small.encode("latin-1").translate(TO_WORDS, b"\xad").decode("latin-1").encode().split()
    except UnicodeEncodeError:
        pass
    found = _word().findall(composed(text))
    pairs = [run[i : i + 2] for w in found for run in DENSE.findall(w) for i in range(len(run) - 1)]
    return [w.encode("utf-8", "surrogatepass") for w in found + pairs]


def suspicious(raw: bytes) -> bool:
    """Whether the text holds a sign beside a letter, a letter three times, or three single characters in a row."""
    return any(suspicions(raw))


def suspicions(raw: bytes) -> tuple[bool, bool]:
    """Whether the text holds a sign beside a letter or a letter three times; and whether three single characters in a row.

    Stars that end a word two or more at a time are marks, no signs.
    """
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 3:
        return False, False
    kind = KIND[b]
    letter = kind == 1
    sign, star = kind == 2, np.concatenate((b == ord(WILD), [False]))
    inside = bool((sign[:-1] & letter[1:]).any() or (letter[:-1] & sign[1:] & ~(star[1:-1] & star[2:])).any())
    if not inside:
        same = b[1:] == b[:-1]
        inside = bool((same[1:] & same[:-1] & letter[2:]).any())
    some = np.concatenate(([False], kind > 0, [False]))
    alone = some[1:-1] & ~some[:-2] & ~some[2:]
    # Number of each single character among all characters of the model: three in a row have no other between.
    place = np.cumsum(some[1:-1])[alone]
    return inside, bool((place[2:] - place[:-2] == 2).any())


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each piece of a disguised token what may be meant: (letters, cost); a space is a word end."""
    out, i = [], 0
    while i < len(token):
        c, n = token[i], 1
        apart = lambda x: not ("a" <= x <= "z" or x in LEET or x == WILD)
        while i + n < len(token) and (token[i + n] == c if "a" <= c <= "z" else apart(c) and apart(token[i + n])):
            n += 1
        if "a" <= c <= "z":
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, PAIR_COST)] if n == 2 else [(c, RUN_COST), (c * 2, RUN_COST)])
        elif c == WILD:
            out.append([("", DROP_COST)] + [(chr(k), WILD_COST) for k in range(97, 123)])
        elif c in LEET:
            out.append([(m, SIGN_COST) for m in LEET[c]] + [("", DROP_COST)])
        else:
            out.append([("", JOIN_COST), (" ", SPLIT_COST)])
        i += n
    return out


def _wild_step(states: dict[int, tuple[float, tuple]], cost: np.ndarray, mask: int) -> dict[int, tuple[float, tuple]]:
    """Any letter or none after each state; one state is kept for each context."""
    contexts, totals = np.array(list(states)), np.array([s[0] for s in states.values()])
    packed = contexts[:, None] << BITS | np.arange(1, 27)
    at = np.concatenate((contexts[:, None], packed & mask), axis=1).ravel()
    total = np.concatenate(((totals + DROP_COST)[:, None], (totals + WILD_COST)[:, None] + cost[packed]), axis=1).ravel()
    order = np.lexsort((total, at))
    first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    if len(first) > BEAM:
        first = first[np.argsort(total[first], kind="stable")[:BEAM]]
    texts = [s[1] for s in states.values()]
    return {int(at[k]): (float(total[k]), (texts[k // 27], chr(96 + k % 27)) if k % 27 else texts[k // 27]) for k in first.tolist()}


def viterbi(options: list[list[tuple[str, float]]], cost: array) -> str:
    """The cheapest reading under channel and language model; ``cost`` has -log P(symbol | three before) by packed symbols.

    Readings are kept as links to what they continue, so the work grows with the token's length only.
    """
    mask = (1 << BITS * (ORDER - 1)) - 1
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    table = np.frombuffer(cost, np.float32)
    for choices in options + [[(" ", 0.0)]]:
        if len(choices) == 27 and len(states) > 4:
            states = _wild_step(states, table, mask)
            continue
        new: dict[int, tuple[float, tuple]] = {}
        for context, (so_far, text) in states.items():
            for letters, extra in choices:
                at, total = context, so_far + extra
                for c in letters:
                    packed = at << BITS | (0 if c == " " else ord(c) - 96)
                    total += cost[packed]
                    at = packed & mask
                if at not in new or total < new[at][0]:
                    new[at] = total, (text, letters)
        if len(new) > BEAM:
            new = dict(sorted(new.items(), key=lambda s: s[1][0])[:BEAM])
        states = new
    least = min(s[0] for s in states.values())
    return min(_spelt(link) for total, link in states.values() if total == least).strip()


def _spelt(link: tuple) -> str:
    letters = []
    while link:
        link, some = link
        letters.append(some)
    return "".join(reversed(letters))


class Restorer:
    """Words of a text, with disguised ones decoded; decoded tokens are kept in bounded memory."""

    def __init__(self, cost: array):
        self.cost, self.held = cost, {}

    def decode(self, token: str) -> str:
        """The best reading of the token, and before it that without repeated marks at the end, if it has such."""
        if token not in self.held:
            if len(self.held) >= HELD:
                self.held.clear()
            found = " ".join(viterbi(lattice(t), self.cost) for t in dict.fromkeys((TRAIL.sub("", token), token)) if t)
            if len(token) > LONGEST_HELD:
                return found
            self.held[token] = found
        return self.held[token]

    def restored(self, raw: bytes) -> list[str]:
        if not suspicious(raw):
            return []
        base = raw.translate(TO_BASE).decode("latin-1")
        return [self.decode(m.group()) for p in (SIGNED, REPEATED, SPACED) for m in p.finditer(base)]

    def words(self, text: str) -> list[bytes]:
        """The words of the text, those that look alike in Latin letters, then those of its decoded tokens."""
        raw, found = latin(text), all_words(text)
        if not text.isascii() and (folded := raw.translate(TO_WORDS, b"\xad").decode("latin-1").encode().split()) != found:
            found = found + folded
        return found + " ".join(self.restored(raw)).encode().split()


def features(word: bytes) -> list[bytes]:
    """The word itself and its proper beginnings, marked by a hyphen."""
    if word.isascii():
        return [word] + [word[:k] + b"-" for k in PREFIXES if len(word) > k]
    letters = word.decode("utf-8", "surrogatepass")
    return [word] + [letters[:k].encode("utf-8", "surrogatepass") + b"-" for k in PREFIXES if len(letters) > k]


@dataclass
class Model:
    """Language model costs, the features' places and weights, and the intercept of the logistic score."""

    cost: array
    places: dict[bytes, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0


class Scorer:
    """A model in a worker, with the features of the pieces of text met so far in bounded memory.

    Words and disguised words don't cross white space, so what a piece between white space adds to a text is worked out once:
    its words with known features, and, for texts in which something is disguised, those of its decoded tokens.
    """

    def __init__(self, model: Model):
        self.model, self.restorer = model, Restorer(model.cost)
        self.heads = {f[:3] for f in model.places}  # a word and its beginnings share their first three bytes
        self.held: dict[bytes, tuple] = {}
        self.plain: dict[bytes, tuple] = {}
        self.decoded: dict[bytes, tuple] = {}

    def _known(self, words) -> tuple:
        """The words with known features, and these."""
        out, held, places = [], self.held, self.model.places
        for w in words:
            if w[:3] not in self.heads:
                continue
            own = held.get(w)
            if own is None:
                if len(held) >= HELD:
                    held.clear()
                own = held[w] = tuple(places[f] for f in features(w) if f in places)
            if own:
                out.append((w, own))
        return tuple(out)

    def _plain(self, piece: bytes) -> tuple:
        return self._known(piece.translate(TO_WORDS, b"\xad").decode("latin-1").encode().split())

    def _decoded(self, piece: bytes) -> tuple:
        base = piece.translate(TO_BASE)
        if not DISGUISED.search(base):
            return ()
        base = base.decode("latin-1")
        found = [self.restorer.decode(m.group()) for p in (SIGNED, REPEATED) for m in p.finditer(base)]
        return self._known(" ".join(found).encode().split()) if found else ()

    def _of_pieces(self, pieces: set[bytes], held: dict[bytes, tuple], make) -> dict[bytes, tuple]:
        if len(held) + len(pieces) > HELD:
            held.clear()
        found: dict[bytes, tuple] = {}
        for piece in pieces:
            own = held.get(piece)
            if own is None:
                own = make(piece)
                if len(piece) <= LONGEST_HELD:
                    held[piece] = own
            if own:
                found.update(own)
        return found

    def known_words(self, text: str) -> dict[bytes, tuple]:
        try:
            raw = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return dict(self._known(set(self.restorer.words(text))))
        pieces = set(raw.split())
        found = self._of_pieces(pieces, self.plain, self._plain)
        inside, apart = suspicions(raw)
        if inside or apart:
            found.update(self._of_pieces(pieces, self.decoded, self._decoded))
        if apart:
            base = raw.translate(TO_BASE).decode("latin-1")
            found.update(self._known(" ".join(self.restorer.decode(m.group()) for m in SPACED.finditer(base)).encode().split()))
        return found

    def counts(self, text: str) -> dict[int, int]:
        """How many distinct words have each known feature, at most MOST_COUNTED."""
        out: dict[int, int] = {}
        for own in self.known_words(text).values():
            for i in own:
                out[i] = min(MOST_COUNTED, out.get(i, 0) + 1)
        return out

    def score(self, text: str) -> float:
        model = self.model
        x = model.intercept + sum(model.weights[i] * n for i, n in sorted(self.counts(text).items()))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def symbol_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram (packed symbols), n: counts over all rows and whole texts; a task sums up what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS * ORDER
        total = np.zeros(size, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                s = SYMBOL[np.frombuffer(b"   " + b"   ".join(map(latin, texts[at : at + 64])) + b" ", np.uint8)]
                grams = s[:-3] << 3 * BITS | s[1:-2] << 2 * BITS | s[2:-1] << BITS | s[3:]
                total += np.bincount(grams[(s[2:-1] > 0) | (s[3:] > 0)], minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["gram", "n"])

    counted = map_arrow(docs.select(text_or_empty(text_col).alias("text")), run, "gram int, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: DataFrame) -> array:
    """-log P(symbol | three before), each order smoothed by the next lower one. At most 2^20 counts reach the driver."""
    table = grams.toArrow()
    n = np.zeros(1 << BITS * ORDER)
    n[table["gram"].to_numpy()] = table["n"].to_numpy()
    k = 1 << BITS
    lower = np.full(k, 1 / 27)
    lower[27:] = 1e-9
    for order in range(1, ORDER + 1):
        own = n.reshape(-1, k**order).sum(axis=0).reshape(-1, k)
        prior = np.tile(lower.reshape(-1, k), (own.shape[0] // lower.reshape(-1, k).shape[0], 1))
        lower = (own + 5.0 * prior) / (own.sum(axis=1, keepdims=True) + 5.0)
    return array("f", -np.log(lower.ravel()).astype(np.float32))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most ``rows`` labelled documents that are not held out.

    Bounded by ``rows``, so it is broadcast. Repeated labels of a document count once, as toxic if any says so.
    """
    named = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    named = named.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taken), "doc_id")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _sketch(words: list[bytes]) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    from xxhash import xxh64_intdigest

    return min((xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def _feature_counts(rows: DataFrame, cost) -> DataFrame:
    """feature, t, c: toxic and clean training documents that hold it. A group of near copies counts about once."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(cost.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                words = [restorer.words(t) for t in b.column("text").to_pylist()]
                found = pa.array([_sketch(w) for w in words], pa.int64())
                restored = pa.array([b" ".join(w).decode() for w in words], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), found, b.column("toxic"), restored], ["doc_id", "sketch", "toxic", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column("words"), b.column("toxic").to_pylist()):
                counts[y > 0].update({f for w in set(t.as_py().encode().split()) for f in features(w)})
        found = sorted(counts[0].keys() | counts[1].keys())
        columns = {"feature": [f.decode("utf-8", "replace") for f in found], "t": [counts[1][f] for f in found], "c": [counts[0][f] for f in found]}
        yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("feature", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = map_arrow(rows.select("doc_id", "toxic", "text"), sketches, f"doc_id {kind}, sketch bigint, toxic int, words string")
    first = marked.groupBy("sketch", "toxic").agg(F.min_by("words", "doc_id").alias("words"))
    counted = map_arrow(first.select("toxic", "words"), count, "feature string, t bigint, c bigint")
    return counted.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _telling(counts: DataFrame, bad: int, good: int) -> list[bytes]:
    """The features with the largest likelihood ratio among those that toxic texts hold more often."""
    t, c, all_t, all_c = F.col("t"), F.col("c"), F.lit(float(bad)), F.lit(float(good))
    share = (t + c) / (all_t + all_c)
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    g = 2 * (term(t, share * all_t) + term(c, share * all_c) + term(all_t - t, (1 - share) * all_t) + term(all_c - c, (1 - share) * all_c))
    chosen = counts.filter((t >= LEAST_DOCS) & (t / all_t > 2 * c / all_c)).select("feature", g.alias("g")).filter(F.col("g") >= LEAST_G)
    return [r["feature"].encode() for r in chosen.orderBy(F.desc("g"), "feature").limit(MOST_FEATURES).collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Language model from all of ``docs``; a logistic regression from labelled rows that are not held out.

    Without both classes among the labels, or without telling features, the model gives every text the smoothed
    share of toxic labels.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    model = Model(language_model(symbol_grams(docs)))
    sample = scratch.put(training_rows(docs, labels, rows), "toxicity-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    rate = (bad + 1) / (bad + good + 10)
    model.intercept = math.log(rate / (1 - rate))
    if bad and good:
        counts = scratch.put(_feature_counts(sample, spark.sparkContext.broadcast(model.cost)), "toxicity-features")
        telling = _telling(counts, bad, good)
        scratch.drop("toxicity-features")
        if telling:
            model.places = {f: i for i, f in enumerate(telling)}
            model.intercept, model.weights = _regress(sample, model, scratch)
    scratch.drop("toxicity-sample")
    return model


def _regress(sample: DataFrame, model: Model, scratch: Scratch) -> tuple[float, list[float]]:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Matrices

    shared, size = sample.sparkSession.sparkContext.broadcast(model), len(model.places)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = np.zeros((b.num_rows, size))
            for k, t in enumerate(b.column("text").to_pylist()):
                for i, n in scorer.counts(t).items():
                    out[k, i] = n
            labels = pa.array([float(y > 0) for y in b.column("toxic").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([labels, pa.array(list(out), pa.list_(pa.float64()))], ["label", "values"])

    rows = scratch.put(map_arrow(sample.select("text", "toxic"), vectors, "label double, values array<double>"), "toxicity-vectors")
    learner = LogisticRegression(regParam=REGULARISATION, standardization=False, maxIter=100, tol=1e-5)
    learner.setLowerBoundsOnCoefficients(Matrices.dense(1, size, [0.0] * size))  # no telling feature speaks for a text
    fitted = learner.fit(rows.select("label", array_to_vector("values").alias("features")))
    scratch.drop("toxicity-vectors")
    return float(fitted.intercept), [float(w) for w in fitted.coefficients.toArray()]


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of each row (default: all) and its score (0 to 1). Rows are handled alone; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if columns is None else columns) if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                found = pa.array([scorer.score(t) for t in b.column(len(kept)).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), found], [*kept, score_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text_col).alias(free_name(docs, "text_scored")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{score_col}` double"
    return map_arrow(rows, run, schema.lstrip(", "))


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts count as empty and get the score of a text without weighted words. Null labels are not learned
    from. Rows that repeat an id are scored each; empty tables give no rows.
    """
    scored = score(docs, train(docs, labels, rows), score_col="score", columns=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
