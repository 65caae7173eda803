"""Hashed sets of word shingles, made for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5

_U = np.uint64
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed in one go.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes, between: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each run of bytes that aren't ``between`` words: polynomial prefix sums modulo 2^64, mixed."""
    if not raw:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    white = np.concatenate(([True], between[b], [True]))
    edge = white[1:] != white[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    sums = np.concatenate((np.zeros(1, _U), np.add.accumulate(_BYTE[b] * _powers(_BASE, len(b)))))
    h = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(b) + 1)[starts]
    return mix(h ^ ((ends - starts).astype(_U) << _U(40))), starts


def combine(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hash of each n words in a row; fewer words in all make one shingle, none make none."""
    n = min(n, len(words))
    if not n:
        return words
    h = np.zeros(len(words) - n + 1, _U)
    for i in range(n):
        h = h * _U(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return mix(h)


def hashed_words(texts: list[str], between: np.ndarray = _IS_WHITE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: number of the first, hashes of all their words, and where each text's words begin (and the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= BLOCK):
            size += len(raw[end]) + 1
            end += 1
        words, starts = word_hashes(b"\n".join(raw[at:end]), between)
        yield at, words, np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw[at:end]]))
        at = end


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each whole text."""
    return [np.unique(combine(words[a:b], n)) for _, words, borders in hashed_words(texts) for a, b in zip(borders[:-1], borders[1:])]


def set_key(shingles: np.ndarray) -> int:
    """64 bits that name the set (signed)."""
    total = int(np.bitwise_xor.reduce(mix(shingles + _U(0x2545F4914F6CDD1D)), initial=_U(0))) + len(shingles) * _BASE
    return int(mix(np.array([total & MASK], _U)).astype(np.int64)[0])
