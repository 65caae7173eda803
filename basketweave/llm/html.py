"""Main text of web pages: structure marks what is an article, hashed runs of tokens per host tell what repeats outside it."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .shingles import combine, hashed_words

#: Tokens of the shortest repeated substring. Three distinct pages of the host must hold it.
LONG = 8

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|$)|</?[a-zA-Z][^>]*$""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# HTML element names by what they mean for text.
RAW = set("script style title textarea noscript template iframe object svg select button datalist audio video canvas".split())
UNTIL_END = set("script style title textarea".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
BOXES = set("article aside body dialog div fieldset footer form header hgroup main menu nav search section table td ul ol dl p span figure details".split())
MAIN, HARD, SOFT = "main", "hard", "soft"
BY_TAG = {"article": MAIN, "main": MAIN, "nav": HARD, "footer": HARD, "aside": HARD, "dialog": HARD, "menu": HARD, "search": HARD, "form": SOFT, "header": SOFT}
BY_ROLE = {"main": MAIN, "article": MAIN, "navigation": HARD, "contentinfo": HARD, "complementary": HARD, "search": HARD, "banner": SOFT, "alert": SOFT, "dialog": HARD, "form": SOFT}
BY_NAME = {
    **dict.fromkeys("comment comments commentlist disqus respond replies reply related recommended sidebar aside footer nav navbar navigation menu breadcrumb breadcrumbs pagination pager".split(), HARD),
    **dict.fromkeys(
        "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
        "newsletter subscribe subscription share sharing social widget login signup search form header masthead topbar copyright paywall toolbar".split(),
        SOFT,
    ),
    **dict.fromkeys("article content post entry story main maintext articlebody".split(), MAIN),
}


def _kind(tag: str, attributes: str) -> str | None:
    """What an element says about its text: main, soft (not main, unless an article is inside), hard (never main)."""
    found = BY_TAG.get(tag)
    if not attributes or tag in ("html", "body"):
        return found
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in re.sub(r"""=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", attributes).lower().split() or values.get("aria-hidden") == "true":
        return HARD
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return HARD
    kinds = {found, BY_ROLE.get(values.get("role", ""))}
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] not in ("has", "with", "no", "is"):
            kinds.add(BY_NAME.get(words[-1]))
            kinds |= {BY_NAME[w] for w in words if BY_NAME.get(w) == HARD and w.startswith("comment")}
    return next((k for k in (HARD, SOFT, MAIN) if k in kinds), None)


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """The page's text as (zone, tokens) per block, in order; zones: main, out (by structure), open (neither).

    Character references are decoded, inline tags vanish, block tags and line breaks end a block. A structural
    element other than an article that is never closed has no say.
    """
    texts: list[str] = []  # with "\0" between blocks
    marks: list[tuple[int, str, str | None, bool]] = []  # elements: texts before, name, what they say, whether they end
    at = 0
    for m in TAG.finditer(page):
        if m.start() < at:  # inside an element that was skipped
            continue
        texts.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (len(page) if tag in UNTIL_END else at)
        if tag in BLOCK or tag in RAW:
            texts.append("\0")
        if tag in BOXES and not m[3].rstrip().endswith("/"):
            marks.append((len(texts), tag, None if m[1] else _kind(tag, m[3]), bool(m[1])))
    texts.append(page[at:])

    # Which elements are closed; p, span and list items may stay open.
    closed, stack = set(), []
    for k, (_, tag, _, ends) in enumerate(marks):
        if not ends:
            stack.append(k)
        else:
            for j in range(len(stack) - 1, -1, -1):
                if marks[stack[j]][1] == tag:
                    closed.add(stack[j])
                    del stack[j:]
                    break
    pieces: list[tuple[str, str]] = []
    opened: list[tuple[str, str | None]] = []
    zone, done = "open", 0
    for k, (where, tag, kind, ends) in enumerate(marks):
        pieces.append((zone, "".join(texts[done:where])))
        done = where
        if not ends:
            if kind in (HARD, SOFT) and k not in closed:
                kind = None
            if kind == SOFT and tag == "header" and any(o[1] == MAIN for o in opened):
                kind = None
            opened.append((tag, kind))
        else:
            for j in range(len(opened) - 1, -1, -1):
                if opened[j][0] == tag:
                    del opened[j:]
                    break
        kinds = [o[1] for o in opened if o[1]]
        zone = "out" if HARD in kinds else {MAIN: "main", SOFT: "out"}.get(kinds[-1], "open") if kinds else "open"
    pieces.append((zone, "".join(texts[done:])))
    out: list[tuple[str, list[str]]] = []
    carried = ""
    for n, (z, text) in enumerate(pieces):
        carried += text
        if n + 1 < len(pieces) and pieces[n + 1][0] == z:
            continue
        for block in carried.split("\0"):
            tokens = (entities.unescape(block) if "&" in block else block).split()
            if tokens:
                out.append((z, tokens))
        carried = ""
    return out


def runs(page: str) -> tuple[np.ndarray, np.ndarray, int | None]:
    """For each token outside the article, hash of the LONG tokens from there on, and whether one of them is open text.

    Then a hash of all tokens that hold a letter, which copies of a page share; None where the page has an article.
    """
    found = blocks(page)
    stream = [(z, t) for z, tokens in found if z != "main" for t in tokens]
    if len(stream) < LONG:
        return np.zeros(0, np.int64), np.zeros(0, bool), None
    ((_, words, _),) = list(hashed_words([" ".join(t for _, t in stream)]))
    is_open = np.array([z == "open" for z, _ in stream])
    near = np.convolve(is_open, np.ones(LONG, int))[LONG - 1 : len(stream)] > 0
    content = None
    if len(stream) == sum(len(tokens) for _, tokens in found):
        told = " ".join(t for _, t in stream if any(map(str.isalpha, t)))
        content = int.from_bytes(blake2b(told.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
    return combine(words, LONG).astype(np.int64), near, content


def main_text(page: str, repeated: list[int]) -> str:
    """Article text, and open text that isn't covered by the repeated substrings that begin at the given tokens."""
    found = blocks(page)
    stream = [z for z, tokens in found if z != "main" for _ in tokens]
    covered = np.zeros(len(stream) + 1, int)
    for p in repeated:
        covered[p] += 1
        covered[min(p + LONG, len(stream))] -= 1
    covered = np.cumsum(covered)[:-1] > 0
    kept, at = [], 0
    for z, tokens in found:
        if z == "main":
            kept += tokens
            continue
        if z == "open":
            kept += [t for t, c in zip(tokens, covered[at : at + len(tokens)]) if not c]
        at += len(tokens)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Structure says which blocks are the article (article, main, or elements named so) and which are menus,
    headers, footers, sidebars, notices, adverts, forms and comments. All text outside the article forms the
    page's token stream. Each ``LONG`` tokens in a row are hashed, and the distinct pages of the host that hold them
    are counted exactly: runs in three pages or more are repeated substrings, and open text (which structure says
    nothing about) that they cover goes, however little is left. Article text is never cut. Pages without an article that are equal but for tokens
    without letters (numbers, dates) are copies and count as one page, so what only copies share isn't boilerplate.

    No suffix array is built: the repeats of a fixed length that it would show are those of the hashed runs, but for
    clashes of 64 bits. Runs of one host and hash are counted by a partial aggregation, so a host that holds most pages is
    spread over all tasks. A null page counts as empty, a null url as no host; rows that repeat a page wholly
    count as one page; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(id_col, url_col, html_col).alias("page"), F.xxhash64(host).alias("host"), page.alias("html"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for page, host, text in zip(b.column("page").to_pylist(), b.column("host").to_pylist(), b.column("html").to_pylist()):
                starts, near, content = runs(text)
                out[0].append(np.full(len(starts), host))
                out[1].append(starts)
                out[2].append(np.full(len(starts), page))
                out[3].append(np.arange(len(starts), dtype=np.int32))
                out[4].append(near)
                out[5].append(np.full(len(starts), page if content is None else content))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else []).cast(t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()))], ["host", "start", "page", "place", "open", "content"])

    suffix = scratch.put(map_arrow(rows.select("page", "host", "html"), cut, "host bigint, start bigint, page bigint, place int, open boolean, content bigint"), "runs")
    # Exactly three contents or more: the least, the largest, and one that is neither.
    groups = suffix.groupBy("host", "start").agg(F.min("content").alias("low"), F.max("content").alias("high"), F.max("open").alias("open"))
    twice = groups.filter(F.col("open") & (F.col("low") != F.col("high"))).drop("open")
    shared = scratch.put(suffix.join(twice, ["host", "start"]), "shared-runs")
    between = (F.col("content") != F.col("low")) & (F.col("content") != F.col("high"))
    repeated = scratch.put(shared.filter(between).select("host", "start").distinct(), "repeated")
    places = shared.filter("open").join(repeated, ["host", "start"]).groupBy("page").agg(F.collect_set("place").alias("places"))
    places = scratch.put(places, "places")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, p or []) for h, p in zip(b.column("html").to_pylist(), b.column("places").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    joined = rows.select("page_id", "url", "page", "html").join(places, "page", "left").select("page_id", "url", "html", "places")
    return map_arrow(joined, build, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
