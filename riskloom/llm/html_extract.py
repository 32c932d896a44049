"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block. A line's size is its text length less twice that of its links, times a
weight: what can't be article text (scripts, menus, forms, adverts, comments and the like, known by element, role, class or
id) weighs nothing, lines in an ``article`` or ``main`` element weigh more and, on a page that has one, lines beside it weigh
less. Sizes are summed over sliding windows of ``WINDOW`` lines. A surge is where a window's sum first reaches the surge
threshold, led back over lines before it that are no dive themselves; a dive is where a window's sum falls below the dive
threshold. The main text is the text between surges and dives, but for stretches whose greatest window is poor next to that of
the richest one. Names weigh only: menus, adverts and comments beside an article go because no stretch reaches them; a line that
weighs nothing amid an article's own lines, or on a page without an article, is a dive by itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices

WINDOW = 3
#: Least sum of a window for a surge, and the share of the page's greatest window that is enough on small pages and that a
#: stretch needs to be kept.
SURGE_CHARS, SURGE_SHARE = 80.0, 0.25
#: A sum below it is a dive.
DIVE_CHARS = 4.0
#: Weights of lines: in an article, on a page without one, beside one.
IN_ARTICLE, PLAIN, BESIDE_ARTICLE = 4.0, 1.0, 0.03
#: Open elements looked through for the paragraph or item that a new block ends.
MOST_INLINE = 16

_NAME = r"[a-zA-Z][^\s/>]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({_NAME})|<[!?][^>]*(?:>|\Z)", re.S)
#: What follows a tag's name: with quoted values, or up to the first > where the quotes don't close.
_QUOTED, _PLAIN = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile(r"([^>]*)>")
_SPECIAL = re.compile("[>\"']")
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")

# Element names and the words of classes, ids and roles that mark what is not article text.
RAW_TEXT = frozenset("script style noscript template textarea title svg iframe object math canvas xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an end tag of another one inside them doesn't close.
BARRIERS = frozenset("article main body".split())
MARKED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus pagination pager toolbar skip login search".split()
)
#: First words of class names that tell of a state, as in with-sidebar.
STATES = frozenset("with has no without is js layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


def _marked(name: str, raw: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("body", "html", "article", "main") or not raw.strip(" /"):
        return False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for each in value.split():
                words = re.split(r"[^a-z0-9]+", each)
                if words[0] not in STATES and not MARKED.isdisjoint(words):
                    return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Line(NamedTuple):
    """A block's text, its characters in links, whether it can't be article text, whether an article element holds it."""

    text: str
    links: int
    dropped: bool
    in_article: bool


class _Open(NamedTuple):
    name: str
    dropped: bool
    in_article: bool
    in_link: bool


class _Quotes:
    """Whether a tag's quotes close before a > ends it. What is found out from one place holds for all places on the way, so a page is
    looked through once for each kind of quote, however many tags stay open."""

    def __init__(self, page: str, end: int) -> None:
        self.page, self.end, self.known = page, end, {}
        self.last = {q: page.rfind(q, 0, end) for q in "\"'"}

    def close(self, at: int) -> bool:
        passed = []
        while True:
            m = _SPECIAL.search(self.page, at, self.end)
            if not m or m[0] == ">":
                found = m is not None
                break
            k = m.start()
            if k in self.known:
                found = self.known[k]
                break
            passed.append(k)
            if k >= self.last[m[0]]:
                found = False
                break
            at = self.page.index(m[0], k + 1) + 1
        self.known.update(dict.fromkeys(passed, found))
        return found


def lines_of(page: str) -> list[Line]:
    """The blocks in page order, in time linear in the page."""
    lines: list[Line] = []
    parts: list[str] = []
    links = 0
    stack: list[_Open] = []
    names = [Counter()]  # of the open elements inside each barrier
    last_end = page.rfind(">")
    quotes = _Quotes(page, last_end + 1)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = stack[-1] if stack else _Open("", False, False, False)
                lines.append(Line(text, min(links, len(text)), own.dropped, own.in_article))
            parts.clear()
        links = 0

    def text_at(start: int, end: int) -> None:
        nonlocal links
        if end > start:
            parts.append(page[start:end])
            if stack and stack[-1].in_link:
                links += end - start

    def push(x: _Open) -> None:
        stack.append(x)
        names[-1][x.name] += 1
        if x.name in BARRIERS:
            names.append(Counter())

    def pop_to(k: int) -> None:
        if any(x.name not in INLINE for x in stack[k:]):
            flush()
        while len(stack) > k:
            x = stack.pop()
            if x.name in BARRIERS:
                names.pop()
            names[-1][x.name] -= 1

    at = 0
    while at <= last_end and (m := _TOKEN.search(page, at, last_end + 1)):
        text_at(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m.end() > last_end and not m[0].endswith(">"):  # a comment or declaration without an end
                at = len(page)
            continue
        closing, rest = m[1], (_QUOTED if quotes.close(at) else _PLAIN).match(page, at, last_end + 1)
        if not rest:  # no > is left
            text_at(m.start(), at)
            break
        raw, at = rest[1], rest.end()
        if closing:
            if names[-1][name] > 0 or (name in BARRIERS or name == "html") and any(c[name] > 0 for c in names):
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            elif name in ("p", "br"):
                flush()
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}[^<>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - MOST_INLINE), -1):
                if stack[k].name == "p" and name != "br" or stack[k].name == name == "li":
                    pop_to(k)
                    break
                if stack[k].name not in INLINE and stack[k].name != "p":
                    break
        if name in VOID or name in INLINE and raw.rstrip().endswith("/"):
            continue
        over = stack[-1] if stack else _Open("", False, False, False)
        dropped = over.dropped or _marked(name, raw, over.in_article) or over.name == "header" and name not in HEADINGS and name not in ("div", "hgroup")
        if name not in INLINE and dropped != over.dropped:
            flush()
        push(_Open(name, dropped, over.in_article or name in ("article", "main"), name == "a" or over.in_link and name in INLINE))
    unfinished = _UNFINISHED.search(page, at)
    text_at(at, unfinished.start() if unfinished else len(page))
    flush()
    return lines


def weighted_sizes(lines: list[Line]) -> list[float]:
    held = any(x.in_article and not x.dropped for x in lines)
    beside = BESIDE_ARTICLE if held else PLAIN
    return [0.0 if x.dropped else (IN_ARTICLE if x.in_article else beside) * max(0, len(x.text) - 2 * x.links) for x in lines]


def stretches(sizes: list[float]) -> list[tuple[int, int]]:
    """(first line, end) between each surge and the dive after it, by window sums, of those rich enough to keep."""
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    most = max(sums, default=0.0)
    surge = min(SURGE_CHARS, SURGE_SHARE * most)
    dive = min(DIVE_CHARS, surge)
    out, i, last = [], 0, 0
    while most > 0 and i < len(sizes):
        if sizes[i] > 0 and sums[i] >= surge:
            start = end = i
            while start > last and sizes[start - 1] >= dive:
                start -= 1
            while end < len(sizes) and sums[end] >= dive:
                end += 1
            if max(sums[i:end]) >= SURGE_SHARE * most:
                out.append((start, end))
            i = last = end
        else:
            i += 1
    return out


def main_text(page: str | None) -> str:
    """The main text; empty for null, empty and textless pages. Beside an article names only weigh: what stands there goes as no
    stretch reaches it. A marked line amid the article's own, or on a page without an article, is a dive of one line."""
    lines = lines_of(page or "")
    held = any(x.in_article and not x.dropped for x in lines)
    kept = (lines[i] for a, b in stretches(weighted_sizes(lines)) for i in range(a, b))
    return " ".join(x.text for x in kept if not (x.dropped and (x.in_article or not held)) and (x.in_article or x.links < len(x.text)))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of text).

    Null and empty html give an empty text. Unclosed elements end with their parents, unclosed scripts and comments at the
    end of the page. Null ids and urls pass through, repeated rows are each extracted, other columns are ignored.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
