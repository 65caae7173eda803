"""Secrets in texts: fixed patterns, and literals that are assigned to names which ask for a secret."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty
from .secret_syntax import Operand, assignments
from .secret_values import Constants

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "pair")

#: Name parts that ask for a secret, with their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "apikey": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3,
    "credential": 2, "credentials": 2, "token": 2, "bearer": 2, "authorization": 2, "auth": 1, "key": 1, "pass": 2, "signature": 1, "salt": 1,
}
#: What a text must hold before it is lexed, in lower case.
FRAGMENTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "signature", "salt")
PLACEHOLDER = re.compile(
    r"^(?:x+|\*+|\.+|-+|<.*>|\$\{.*\}|\$\w+|%\(.*\)s|\{\{.*\}\}|(?:your|my|the|example|sample|change|test|dummy|none|null|true|false|todo|undefined|required|optional|string|invalid|wrong|incorrect|enter|please|hidden|redacted|forgot|missing|passw|process\.env|os\.environ).*)$",
    re.I | re.S,
)
#: The name of a setting, which is no secret if it asks for one.
IDENTIFIER = re.compile(r"[A-Za-z]++(?:[_.:/-][A-Za-z]++)++$")
#: A phrase of small words, as people choose them for a passphrase.
PHRASE = re.compile(r"[a-z]{2,12}+(?:[ -][a-z]{2,12}+){3,7}+$")
LEAST_SCORE = 5.0


def name_weight(name: str) -> int:
    """How strongly a name asks for a secret: the heaviest of its parts, or of two parts next to each other."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    both = [a + b for a, b in zip(parts, parts[1:])]
    return max([SENSITIVE.get(p, 0) for p in parts + both], default=0)


def literal_score(value: str, quoted: bool = False, counts: dict[str, float] | None = None) -> float:
    """Bits per character, plus half a point per kind of character; 0 for placeholders, sentences and short values.

    Values of one kind of character count half unless they are quoted. A quoted phrase of four to eight small words scores as a word does.
    ``counts`` are those of the whole value where ``value`` is the outline of a long one (``secret_values.Value``); that is no setting's name.
    """
    if len(value) < 8 or PLACEHOLDER.match(value) or counts is None and IDENTIFIER.match(value) and name_weight(value) > 1:
        return 0.0
    phrase = quoted and PHRASE.match(value)
    if re.search(r"\s", value) and not phrase:
        return 0.0
    counts = counts or Counter(value)
    total = sum(counts.values())
    bits = -sum(n / total * math.log2(n / total) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in (r"\d", r"[a-z]", r"[A-Z]", r"[^A-Za-z0-9]"))
    if kinds > 1 and not phrase:
        return bits + kinds / 2
    return bits if quoted else bits / 2


def assigned_literals(text: str) -> list[tuple[int, int]]:
    """Spans (code points) of literals that reach a sensitive name and look like secrets.

    The text is lexed and its assignments are read (``secret_syntax``); then constants are followed through other names, also
    those defined after their use, however many names and literals that takes. Joined operands make one value. A value scores by its
    own look and by the weight of the name it is assigned to; where it came by way of other names, the spans
    are those of the literals, wherever they stand.
    """
    read = assignments(text)
    weights = [name_weight(one.name) for one in read]
    if not any(weights):
        return []
    constants, places, found = Constants(text, read), set(), set()
    for k, parts, value in constants.resolved({k for k, weight in enumerate(weights) if weight}):
        if literal_score(value.outline(text), weights[k] >= 3 and value.quoted, value.counts) + weights[k] >= LEAST_SCORE:
            places.update(p for p in parts if isinstance(p, int))
            found.update((p.start, p.end) for p in parts if isinstance(p, Operand) and p.end > p.start)
    found.update((o.start, o.end) for o in constants.literals(places) if o.end > o.start)
    return sorted(found)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind. A literal within a base span is not listed again."""
    lower = text.lower()
    spans = []
    if any(k in lower for k in ("passw", "secret", "token", "api")):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if (any(c in text for c in ":=(<") or "--" in text or "env " in lower or "arg " in lower) and any(k in lower for k in (*FRAGMENTS, "://")):
        spans += [(a, b, "pair") for a, b in assigned_literals(text) if not any(s <= a and b <= e for s, e, _ in spans)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_pair.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind (assign, access, hex, pair),
    joined by commas; ``base_sha256`` is the digest of that list without the kind pair. Each row is scanned whole
    and alone, nothing is shuffled. A null text counts as empty: no spans, the digest of ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t) for t in b.column("text").to_pylist()]
            join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
            count = lambda kind: pa.array([sum(k == kind for _, _, k in f) for f in found], pa.int64())
            base = [hashlib.sha256(join([x for x in f if x[2] != "pair"]).encode()).hexdigest() for f in found]
            columns = [b.column("doc_id"), *map(count, KINDS[:3]), pa.array(base, pa.string()), pa.array(map(join, found), pa.string()), count("pair")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pair"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_pair bigint")
