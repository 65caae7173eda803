"""What the names of a text stand for: literals, joined by way of other names.

References are followed to their end. A joined value is never spelt out: of a long one its ends, the characters in between and
their counts are kept, which add up, so the time is in proportion to the text whatever refers to what.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

from .secret_syntax import Assignment, Operand

#: Characters up to which a joined value is kept as it is, and those kept of each end of a longer one.
WHOLE, END = 256, 128
#: Counts are scaled down beyond this; below 2**53 they are exact.
MOST = 2.0**900


class Value:
    """A string joined of literals: one literal's span, a short string, or a long one's ends and counts."""

    __slots__ = ("span", "short", "head", "tail", "counts", "scale", "quoted")

    def __init__(self, span: Operand | None = None, quoted: bool = False):
        self.span, self.quoted = span, quoted or bool(span and span.quoted)
        self.short, self.head, self.tail = "", "", ""
        self.counts, self.scale = None, 0

    def empty(self) -> bool:
        return self.counts is None and not self.short and (self.span is None or self.span.end <= self.span.start)

    def ends(self, text: str) -> tuple[str, str]:
        """Its first and last ``END`` characters."""
        if self.counts is not None:
            return self.head, self.tail
        if self.span:
            return text[self.span.start : min(self.span.start + END, self.span.end)], text[max(self.span.end - END, self.span.start) : self.span.end]
        return self.short[:END], self.short[-END:]

    def whole(self, text: str) -> str:
        return text[self.span.start : self.span.end] if self.span else self.short

    def outline(self, text: str) -> str:
        """The value, or a long one's ends with each character that occurs between them once: it fits the same patterns."""
        if self.counts is None:
            return self.whole(text)
        kept = Counter(self.head + self.tail)
        between = self.counts if self.scale else {c for c, n in self.counts.items() if n > kept[c]}
        return self.head + "".join(sorted(between)) + self.tail

    def size(self) -> int:
        return self.span.end - self.span.start if self.span else len(self.short)


def join(parts: list[Value], text: str) -> Value:
    """The parts one after another."""
    given = [p for p in parts if not p.empty()]
    quoted = any(p.quoted for p in parts)
    if len(given) == 1:
        if given[0].quoted == quoted:
            return given[0]
        out = Value(given[0].span, quoted)
        out.short, out.head, out.tail, out.counts, out.scale = given[0].short, given[0].head, given[0].tail, given[0].counts, given[0].scale
        return out
    out = Value(None, quoted)
    if all(p.counts is None for p in given) and sum(p.size() for p in given) <= WHOLE:
        out.short = "".join(p.whole(text) for p in given)
        return out
    out.scale = max(p.scale for p in given)
    out.counts = {}
    heads, tails, head, tail = [], [], 0, 0
    for p in given:
        counts = Counter(p.whole(text)) if p.counts is None else p.counts
        for c, n in counts.items():
            out.counts[c] = out.counts.get(c, 0.0) + math.ldexp(n, p.scale - out.scale)
        if head < END:
            heads.append(p.ends(text)[0][: END - head])
            head += len(heads[-1])
    for p in reversed(given):
        if tail >= END:
            break
        last = p.ends(text)[1]
        tails.append(last[max(0, len(last) - END + tail) :])
        tail += len(tails[-1])
    out.head, out.tail = "".join(heads), "".join(reversed(tails))
    if max(out.counts.values()) > MOST:
        out.counts, out.scale = {c: math.ldexp(n, -800) for c, n in out.counts.items()}, out.scale + 800
        out.counts = {c: n for c, n in out.counts.items() if n}
    return out


class Constants:
    """What each assignment's value is made of: its literals, and those of the names it refers to.

    A name stands for its latest assignment before the place, or for the first one after it; all alternatives of that are
    joined. Names that refer to each other in a circle stand for all that the circle joins, in the order of the text, each
    literal once.
    """

    def __init__(self, text: str, found: list[Assignment]):
        self.text, self.found = text, found
        self.at: dict[str, list[int]] = {}
        for k, one in enumerate(found):
            self.at.setdefault(one.name, []).append(k)
        self.circle: dict[int, int] = {}  # assignment -> number of the circle it is in, or of itself alone
        self.values: dict[int, Value] = {}  # of circles that something is still joined with
        self._parts: dict[int, list[list[int | Operand]]] = {}

    def target(self, operand: Operand, k: int) -> int:
        """The assignment that a bare operand of assignment k refers to, or -1."""
        if operand.quoted or operand.end - operand.start > 80:
            return -1
        places = self.at.get(self.text[operand.start : operand.end])
        if not places:
            return -1
        before = bisect_left(places, k)
        found = places[before - 1] if before else places[0]
        return -1 if found == k else found

    def parts(self, k: int) -> list[list[int | Operand]]:
        """The alternatives of assignment k, each of literals and of assignments that it refers to."""
        if k not in self._parts:
            self._parts[k] = [[o if (t := self.target(o, k)) < 0 else t for o in v] for v in self.found[k].values]
        return self._parts[k]

    def references(self, k: int) -> Iterator[int]:
        return (p for v in self.parts(k) for p in v if isinstance(p, int))

    def resolved(self, wanted: set[int]) -> Iterator[tuple[int, list[int | Operand], Value]]:
        """``(assignment, alternative, value)`` of the wanted assignments. A value is dropped once all that refer to it are joined."""
        reached = self.reach(wanted)
        users = Counter(p for k in reached for p in self.references(k))
        left: dict[int, int] = {}
        for start in sorted(wanted):
            for members in self._circles(start):
                here = self.circle[members[0]]
                refers = [p for m in members for p in self.references(m)]
                outside = [p for p in refers if self.circle[p] != here]
                parts = (p for m in members for v in self.parts(m) for p in v)
                mine = self._joined(p for p in parts if not isinstance(p, int) or self.circle[p] != here)
                for m in members:
                    for v in self.parts(m) if m in wanted else ():
                        inside = any(isinstance(p, int) and self.circle[p] == here for p in v)
                        yield m, v, mine if inside else self._joined(v)
                for p in outside:
                    left[self.circle[p]] -= 1
                    if not left[self.circle[p]]:
                        del self.values[self.circle[p]]
                left[here] = sum(users[m] for m in members) - (len(refers) - len(outside))
                if left[here]:
                    self.values[here] = mine

    def reach(self, places: Iterable[int]) -> set[int]:
        """The assignments, and all that they refer to."""
        seen = set(places)
        left = list(seen)
        while left:
            new = {p for p in self.references(left.pop()) if p not in seen}
            seen |= new
            left += new
        return seen

    def literals(self, places: Iterable[int]) -> Iterator[Operand]:
        """All literals that the assignments join."""
        return (p for k in self.reach(places) for v in self.parts(k) for p in v if not isinstance(p, int))

    def _joined(self, parts: Iterable[int | Operand]) -> Value:
        return join([self.values[self.circle[p]] if isinstance(p, int) else Value(p) for p in parts], self.text)

    def _circles(self, start: int) -> Iterator[list[int]]:
        """Tarjan's strongly connected components of what ``start`` refers to and no earlier start did, innermost first."""
        if start in self.circle:
            return
        order, low, open_, path = {start: 0}, {start: 0}, [start], [(start, self.references(start))]
        while path:
            k, rest = path[-1]
            for p in rest:
                if p in self.circle:
                    continue
                if p not in order:
                    order[p] = low[p] = len(order)
                    open_.append(p)
                    path.append((p, self.references(p)))
                    break
                low[k] = min(low[k], order[p])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[k])
                if low[k] == order[k]:
                    at = len(open_) - 1
                    while open_[at] != k:
                        at -= 1
                    members, number = sorted(open_[at:]), len(self.circle)
                    del open_[at:]
                    self.circle.update(dict.fromkeys(members, number))
                    yield members
