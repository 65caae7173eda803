"""A tolerant lexer for source and configuration text, and the name-literal pairs of its assignments.

Lexing and parsing take time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import re
from array import array
from typing import NamedTuple

WORD, STR, OP, NEWLINE = range(4)

_TOKEN = re.compile(
    r"""(?P<word>(?:(?<![\w-])--)?[^\W\d][\w$]*+(?:[.-][\w$]++)*+)|(?P<quote>\"{3}|'{3}|["'`])|(?P<line>\n)|(?P<op>:=|=>|===?|[!<>]=|\?\?|\?=|\+=|\|\||&&|<-|://|</|/>|[^\W]++|\S)""",
    re.X,
)
_CLOSE = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+"'),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*+'"),
    "`": re.compile(r"[^`]*+`"),
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"""', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'''", re.S),
}
_PREFIX = re.compile(r"[rRbBuUfF]{1,2}$")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>+]++""")
_NAME = re.compile(r"[\w$][\w$ .:/-]{0,79}$")
_SCHEME = re.compile(r"(?:bearer|basic|token)[ \t]+", re.I)
_SHELL_DEFAULT = re.compile(r"\$\{\w++:?[-=]([^{}\n]*+)\}")
_USER_INFO = re.compile(r"://[^\s:/@\"'<>]*+:([^\s/@\"'<>]++)@")

SIGNS = {"=", ":=", "=>", "?=", "+=", "<-"}
TYPE_MARKS = set("[],|?.&*")
#: Calls whose first string names what they look up; a second one is its default.
LOOKUPS = {"getenv", "get", "env", "environ", "getproperty", "property", "var", "lookup", "fetch", "getordefault", "setdefault", "config", "param", "input", "getpass"}
KEY_NAMES, VALUE_NAMES = {"key", "name", "id", "param"}, {"value", "val", "default"}
DECLARATIONS = {"env", "arg", "setenv"}


class Operand(NamedTuple):
    start: int
    end: int
    quoted: bool


class Assignment(NamedTuple):
    """``name`` gets one of ``values``, each the operands that are joined to it."""

    name: str
    values: list[list[Operand]]


class Tokens:
    """Kinds, spans and inner spans (strings without their quotes) of all tokens, in arrays; blanks are left out."""

    def __init__(self, text: str):
        self.text, self.kind = text, bytearray()
        self.start, self.end, self.a, self.b = (array("q") for _ in range(4))
        closed_before: dict[str, int] = {}  # a quote that isn't closed opens no string up to here
        at = 0
        while m := _TOKEN.search(text, at):
            kind, (s, e) = m.lastgroup, m.span()
            if kind == "quote":
                q = m.group()
                prefix = bool(self.kind) and self.kind[-1] == WORD and self.end[-1] == s and _PREFIX.match(text, self.start[-1], s)
                opens = s >= closed_before.get(q, 0) and (prefix or s == 0 or not (text[s - 1].isalnum() or text[s - 1] == "_"))
                close = _CLOSE[q].match(text, e) if opens else None
                if close:
                    if prefix:
                        s = self.start.pop()
                        for column in (self.kind, self.end, self.a, self.b):
                            column.pop()
                    self.add(STR, s, close.end(), e, close.end() - len(q))
                    at = close.end()
                    continue
                if opens:
                    line = text.find("\n", e)
                    closed_before[q] = line if len(q) == 1 and q != "`" and line >= 0 else len(text)
                e = s + 1
            self.add(WORD if kind == "word" else NEWLINE if kind == "line" else OP, s, e, s, e)
            at = e
        self.match = self._brackets()

    def add(self, kind: int, s: int, e: int, a: int, b: int) -> None:
        self.kind.append(kind)
        for column, value in zip((self.start, self.end, self.a, self.b), (s, e, a, b)):
            column.append(value)

    def _brackets(self) -> array:
        """For each opening bracket the index of the closing one; -1 elsewhere."""
        match, stack = array("q", [-1]) * len(self.kind), []
        closes = {")": "(", "]": "[", "}": "{"}
        for i in range(len(self.kind)):
            t = self.op(i)
            if t in ("(", "[", "{"):
                stack.append((t, i))
            elif t in closes and stack and stack[-1][0] == closes[t]:
                match[stack.pop()[1]] = i
        return match

    def __len__(self) -> int:
        return len(self.kind)

    def op(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]] if 0 <= i < len(self.kind) and self.kind[i] == OP else ""

    def is_kind(self, i: int, *kinds: int) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] in kinds

    def inner(self, i: int) -> str:
        return self.text[self.a[i] : self.b[i]]

    def touches(self, i: int) -> bool:
        """Whether token i + 1 follows i without a blank."""
        return i + 1 < len(self.kind) and self.end[i] == self.start[i + 1]


def _literal(tokens: Tokens, a: int, b: int, quoted: bool) -> Operand:
    text = tokens.text
    if (m := _SHELL_DEFAULT.match(text, a, b)) and m.end() == b:
        a, b = m.span(1)
    if m := _SCHEME.match(text, a, b):
        a = m.end()
    if not quoted:
        while b > a and text[b - 1] in ".:":
            b -= 1
    return Operand(a, b, quoted)


def _arguments(tokens: Tokens, at: int) -> list[Operand | None]:
    """The arguments of the call whose bracket is token ``at``: literals, None for all else. Inner brackets are skipped."""
    out, parts, j, stop = [], [], at + 1, tokens.match[at]
    while j <= stop:
        t = tokens.op(j)
        if t == "," or j == stop:
            out.append(parts[0] if len(parts) == 1 else None)
            parts = []
        elif tokens.is_kind(j, STR):
            parts.append(_literal(tokens, tokens.a[j], tokens.b[j], True))
        elif not tokens.is_kind(j, NEWLINE):
            parts += [None, None]
        j = max(tokens.match[j], j) + 1
    return out


def _last_part(name: str) -> str:
    return re.split(r"[.:]", name)[-1].lower()


def _call(tokens: Tokens, i: int) -> list[Operand]:
    """The literals that the value of a call may come from."""
    literals = _arguments(tokens, i + 1)
    if _last_part(tokens.inner(i)) in LOOKUPS:
        literals = literals[1:]
    return [x for x in literals if x]


def _value(tokens: Tokens, i: int) -> tuple[list[list[Operand]], int]:
    """The value that begins at token i, as alternatives of joined operands, and the token to go on from."""
    values: list[list[Operand]] = [[]]
    depth, wanted, first, inside = 0, True, i, 0
    while i < len(tokens):
        t, kind = tokens.op(i), tokens.kind[i]
        if kind == NEWLINE:
            if not depth and not (wanted and i > first):
                break
            i += 1
        elif kind == STR and (wanted or depth or tokens.is_kind(i - 1, STR)):
            values[-1].append(_literal(tokens, tokens.a[i], tokens.b[i], True))
            wanted, i = False, i + 1
        elif not wanted and (t in ("||", "??") or kind == WORD and tokens.inner(i) in ("or", "else")):
            values.append([])
            wanted, i = True, i + 1
        elif not wanted and t in ("+", ".", "~", "\\", "&"):
            wanted, i = True, i + 1
        elif t == "(" and wanted:
            depth, i = depth + 1, i + 1
        elif t == ")" and depth:
            depth, wanted, i = depth - 1, False, i + 1
        elif not wanted:
            break
        elif kind == WORD and tokens.op(i + 1) == "(" and tokens.touches(i) and tokens.match[i + 1] > 0:
            values[-1] += _call(tokens, i)
            inside = inside or i + 1
            wanted, i = False, tokens.match[i + 1] + 1
        elif kind == WORD and tokens.op(i + 1) == "[" and tokens.touches(i) and tokens.match[i + 1] == i + 3:
            wanted, i = False, i + 4
        elif t in ("|", ">", "\\") and tokens.is_kind(i + 1, NEWLINE):
            i += 2  # a block of text, or a line that goes on
        elif t == "$" and (bare := _SHELL_DEFAULT.match(tokens.text, tokens.start[i])):
            values[-1].append(_literal(tokens, *bare.span(), False))
            while i < len(tokens) and tokens.start[i] < bare.end():
                i += 1
            wanted = False
        elif bare := _BARE.match(tokens.text, tokens.start[i]):
            here = _literal(tokens, *bare.span(), False)
            while i < len(tokens) and tokens.start[i] < bare.end():
                i += 1
            scheme = tokens.text[here.start : here.end].lower() in ("bearer", "basic") and tokens.is_kind(i, WORD, OP)
            if not scheme:
                values[-1].append(here)
                wanted = False
        else:
            break
    return [v for v in values if v], inside or max(i, first)


def _annotated(tokens: Tokens, i: int) -> int:
    """The token after the = of ``: Type =``, where i follows the colon, or -1."""
    words = 0
    for j in range(i, min(i + 16, len(tokens))):
        if tokens.op(j) == "=":
            return j + 1 if words else -1
        if not (tokens.is_kind(j, WORD) or tokens.op(j) in TYPE_MARKS or tokens.op(j) in ("<", ">")):
            return -1
        words += tokens.is_kind(j, WORD)
    return -1


def _begin(tokens: Tokens, i: int) -> int:
    """The token at which the value of name i begins, or -1 if nothing is assigned to it."""
    j = i + 1
    if tokens.op(j) == "]" and tokens.op(i - 1) == "[":
        j += 1
    if tokens.op(j) == "?" and tokens.op(j + 1) == ":":
        j += 1
    if tokens.op(j) in SIGNS:
        return j + 1
    if tokens.op(j) == ":":
        typed = _annotated(tokens, j + 1)
        return typed if typed > 0 else j + 1
    if not tokens.is_kind(i, WORD):
        return -1
    if tokens.is_kind(i + 1, WORD) and tokens.op(i + 2) == "=":
        return i + 3  # name type = value
    if tokens.text.startswith("--", tokens.start[i]) and i + 1 < len(tokens) and not tokens.touches(i) and not tokens.is_kind(i + 1, NEWLINE):
        return i + 1  # --name value
    if tokens.is_kind(i - 1, WORD) and tokens.inner(i - 1).lower() in DECLARATIONS and tokens.is_kind(i + 1, WORD, STR, OP):
        return i + 1  # ENV name value
    return -1


def assignments(text: str) -> list[Assignment]:
    """All names of ``text`` that get a value, in order.

    Forms: ``name = value`` with any sign, ``name: value``, ``name: type = value``, ``name type = value``,
    ``map["name"] = value``, ``<name>value</name>``, ``key="name" value="value"``, ``set("name", "value")``,
    ``setName("value")``, ``lookup("name", "default")``, ``--name value``, ``ENV name value``, ``kind "name" { default = value }``, and ``scheme://user:password@host``.
    Values are quoted or bare, joined by signs, by standing next to each other, or over lines in brackets; ``||``, ``??`` and
    ``or`` give alternatives.
    """
    tokens, out = Tokens(text), []
    pending, until = "", -1
    i = 0
    while i < len(tokens):
        after = i + 1
        name = tokens.inner(i).lstrip("-") if tokens.is_kind(i, WORD, STR) and tokens.b[i] - tokens.a[i] <= 80 else ""
        if name and _NAME.match(name):
            begin = _begin(tokens, i)
            if begin > 0:
                values, after = _value(tokens, begin)
                after = max(after, i + 1)
                if begin == i + 3 and tokens.is_kind(i + 1, WORD):
                    after = i + 1  # of "type name = value" the second is the name
                if values:
                    out.append(Assignment(name, values))
                    low = _last_part(name)
                    if low in VALUE_NAMES and pending and i <= until:
                        out.append(Assignment(pending, values))
                    if low in KEY_NAMES and len(values) == len(values[0]) == 1:
                        pending, until = text[values[0][0].start : values[0][0].end], i + 12
            elif tokens.is_kind(i, STR) and tokens.is_kind(i - 1, WORD, STR) and tokens.op(i + 1) == "{":
                pending, until = name, tokens.match[i + 1]  # kind "name" { default = value }
            elif tokens.op(i - 1) == "<" and tokens.op(i + 1) == ">":
                j = i + 2
                while j < len(tokens) and tokens.op(j) not in ("<", "</"):
                    j += 1
                if j < len(tokens) and j > i + 2 and tokens.op(j) == "</":
                    a, b = tokens.end[i + 1], tokens.start[j]
                    a += len(text[a:b]) - len(text[a:b].lstrip())
                    out.append(Assignment(name, [[_literal(tokens, a, a + len(text[a:b].rstrip()), True)]]))
                after = j
            elif tokens.is_kind(i, WORD) and tokens.op(i + 1) == "(" and tokens.touches(i) and tokens.match[i + 1] > 0:
                given = _arguments(tokens, i + 1)
                if len(given) > 1 and given[0] and given[1]:
                    out.append(Assignment(text[given[0].start : given[0].end], [[given[1]]]))
                if _last_part(name) not in LOOKUPS:
                    out.append(Assignment(_last_part(name) and re.split(r"[.:]", name)[-1], [[x] for x in given if x]))
        i = after
    at = text.find("://")
    while at >= 0:
        if m := _USER_INFO.match(text, at):
            out.append(Assignment("password", [[Operand(*m.span(1), True)]]))
        at = text.find("://", at + 3)
    return out
