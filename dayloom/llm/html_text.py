"""Main text of web pages by differencing each page against its nearest one by URL.

Pages are sorted by host and path, and each is paired with the neighbour of its host whose path shares
the longest beginning with its own. The text lines (blocks) of the two pages are aligned by their
longest common subsequence, and shared lines are template: they are deleted. Every page with a
neighbour goes through this, whatever it declares. Neighbours with the same URL or the same lines are
copies of the page, whose shared lines say nothing about a template; they are passed over.

Differencing alone cannot tell a template from a copied article: near copies of an article share all
its lines, and a menu or footer that differs between neighbours shares none (README has figures). So
what it leaves is checked against marks in the page: lines inside elements that the page itself
declares to be navigation, header, footer, sidebar, advert, notice, form or comments (by tag, role,
class or id) are never text, and lines inside a declared article are always text. Differencing decides
all other lines. A page without a neighbour has its declared article only, or else all other lines.

An article inside a template element is text where that element is a wrapper: always for <main>, which
HTML allows inside none of them, and where only forms and elements that are never closed enclose it;
inside a widget, modal or other layout box where the page declares no article elsewhere; inside any
element where the page would be empty otherwise.

A partition of pages is a range of the sorted URLs with one page and its copies held at a time, equal
lines once, so a host of any size is spread over tasks; a page at the end of a range is paired inside
its range.

Defined results: null html is empty, a page without text gives an empty string; pages alone in their
host but for copies, or without a host, delete nothing by differencing; broken or unclosed markup is
read as far as it goes; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.rows import OUT_ROWS, with_arrow_columns

ARTICLE, TEMPLATE, OTHER = 2, 0, 1  # what the page itself says about a line
_ENCLOSED = 3  # an article inside a template element, until the page's end decides

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*)")
_STOP = re.compile(r"[\"'<>]")
_ANGLE = re.compile(r"[<>]")
# Elements whose content is no text, and those of them that hold all that follows if never closed.
_HIDDEN = frozenset("script style noscript template svg math iframe object textarea title".split())
_SWALLOWS = frozenset(["script", "style"])


def _tags(source: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closes, tag, attributes) of all markup; tag is None for what is only skipped.

    One pass to the right: a tag ends at the first ``>`` outside quotes. Where a ``<`` comes first, or
    a quote is never closed, it is no tag; in the latter case quotes count for nothing from there on.
    Hidden elements are skipped up to their end tag. Without one, or written as closed in themselves,
    only the tag goes; scripts and styles hold the rest of the page.
    """
    at, quotes = 0, True
    closing: dict[str, int] = {}  # where the next end tag of a hidden element begins, as far as known
    size = len(source)
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        opened = _OPEN.match(source, start)
        if opened is None:
            end = None
            for mark, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if source.startswith(mark, start):
                    found = source.find(close, start + len(mark))
                    end = found + len(close) if found >= 0 else size
            if end is None and source[at : at + 1] in ("!", "?"):
                found = _ANGLE.search(source, at)
                if found is None:
                    return
                at = found.start()
                end = at + 1 if found[0] == ">" else None
            if end is not None:
                yield start, end, False, None, ""
                at = end
            continue
        tag = opened[2].lower()
        here = begin = opened.end()
        end = None
        while end is None:
            stop = (_STOP if quotes else _ANGLE).search(source, here)
            if stop is None:
                break
            if stop[0] == "<":
                at = stop.start()
                break
            if stop[0] == ">":
                end = stop.end()
                break
            here = source.find(stop[0], stop.end()) + 1
            if not here:
                quotes, here = False, begin
        if end is None:
            if stop is None:
                return
            continue
        rest = source[begin : end - 1]
        if tag in _HIDDEN and not opened[1]:
            if rest.endswith("/") and tag not in _SWALLOWS:
                yield start, end, False, None, ""
                at = end
                continue
            if closing.get(tag, -1) < end:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, end)
                closing[tag] = found.start() if found else size
            if closing[tag] < size:
                over = source.find(">", closing[tag])
                end = over + 1 if over >= 0 else size
            elif tag in _SWALLOWS:
                end = size
            yield start, end, False, None, ""
        elif tag in _HIDDEN:
            yield start, end, False, None, ""
        else:
            yield start, end, bool(opened[1]), tag, rest
        at = end


_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNSEEN = re.compile(r"""(?:"[^"]*"|'[^']*'|[^"'])*?\shidden(?=[\s=/]|\Z)(?!\s*=\s*["']?until-found)""", re.I)
_NAMES = re.compile(r"[a-z]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEMPLATE_TAGS = frozenset("nav header footer aside form button select dialog menu head".split())
_TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_TEMPLATE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts "
    "sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login comment comments reply replies respond disqus discussion share "
    "sharing social related breadcrumb breadcrumbs pagination pager widget toolbar".split()
)
# Names beginning like these describe a layout ("with-sidebar"), not the element's own part.
_LAYOUT = ("has", "no", "with", "without", "is", "page", "layout", "js", "wp", "theme")
_WHOLE = frozenset(["html", "body", "main", "article"])
# Names of boxes that may hold a whole page.
_BOXES = frozenset("header modal overlay popup toolbar widget".split())
_ARTICLE_NAMES = frozenset("articlebody entry-content post-content article-content article-body post-body".split())
_CLOSES = {"p": ("p",), "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def _declared(tag: str, rest: str) -> int | None:
    """What an element's tag and attributes say about the lines inside it."""
    names: set[str] = set()
    if rest:
        if "hidden" in rest.lower() and _UNSEEN.match(rest):
            return TEMPLATE
        for found in _ATTRIBUTE.finditer(rest):
            key, value = found[1].lower(), found[2].strip("\"'").lower()
            if key == "role" and value in _TEMPLATE_ROLES:
                return TEMPLATE
            if key == "role" and value in ("main", "article"):
                names.add("articlebody")
            elif key == "aria-hidden" and value == "true":
                return TEMPLATE
            elif key in ("class", "id"):
                names.update(value.split())
    parts = [] if tag in _WHOLE and tag != "article" else [_NAMES.findall(n) for n in names]
    if tag in _TEMPLATE_TAGS or any(p and p[0] not in _LAYOUT and not _TEMPLATE_NAMES.isdisjoint(p) for p in parts):
        return TEMPLATE
    if tag in ("article", "main") or names & _ARTICLE_NAMES:
        return ARTICLE
    return None


class _Around:
    """A template element that may enclose an article, and the one around it."""

    def __init__(self, tag: str, rest: str, parent: _Around | None, inside: int):
        attributes = [(a[1].lower(), a[2].strip("\"'").lower()) for a in _ATTRIBUTE.finditer(rest)]
        names = {n for key, value in attributes if key in ("class", "id") for n in _NAMES.findall(value)}
        boxed = (names & _TEMPLATE_NAMES) <= _BOXES and all(key in ("class", "id") for key, _ in attributes)
        self.parent, self.passes = parent, False
        self.form = tag == "form" and boxed
        # Inside an article these are parts of it, not wrappers.
        self.box = boxed and tag not in _TEMPLATE_TAGS and inside != ARTICLE
        self.closed = tag in _CLOSES or inside == ARTICLE  # the former need no end tag


def _is_main(tag: str, rest: str) -> bool:
    return tag == "main" or any(
        a[1].lower() == "role" and a[2].strip("\"'").lower() == "main" for a in _ATTRIBUTE.finditer(rest)
    )


def _decided(found: list[tuple[int, str, _Around | None]], arounds: list[_Around]) -> list[tuple[int, str]]:
    """The lines, those of enclosed articles as article or template."""
    steps = (
        ((), lambda a: a.form or not a.closed),
        ((ARTICLE,), lambda a: a.form or not a.closed or a.box),
        ((ARTICLE, OTHER), lambda a: True),
    )
    for unless, passes in steps:
        kinds = {kind for kind, _, _ in found}
        if _ENCLOSED not in kinds:
            break
        if kinds.isdisjoint(unless):
            for a in arounds:  # outer ones first
                a.passes = passes(a) and (a.parent is None or a.parent.passes)
            found = [(ARTICLE if k == _ENCLOSED and a.passes else k, line, a) for k, line, a in found]
    return [(TEMPLATE if kind == _ENCLOSED else kind, line) for kind, line, _ in found]


def page_lines(text: str | None) -> list[tuple[int, str]]:
    """The page's blocks of text in order, each with what the page says about it."""
    lines: list[tuple[int, str, _Around | None]] = []
    # Elements, with what holds inside, the innermost template element and whether they are that one.
    open_: list[tuple[str, int, _Around | None, bool]] = []
    arounds: list[_Around] = []
    words: list[str] = []

    def flush() -> None:
        line = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if line:
            lines.append((open_[-1][1], line, open_[-1][2]) if open_ else (OTHER, line, None))

    at = 0
    source = text or ""
    spans: dict[str, int] = {}  # open inline elements that are templates, and their like inside them
    for start, end, closes, tag, rest in _tags(source):
        words.append(source[at:start])
        at = end
        if tag is None:
            continue
        inline = tag in _INLINE
        if inline and closes and not spans.get(tag):
            continue
        if inline and not closes and not spans.get(tag) and not (rest and _declared(tag, rest) == TEMPLATE):
            continue
        if tag not in _VOID or not inline:
            flush()
        if tag in _VOID:
            continue
        if closes:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    if open_[i][3]:
                        open_[i][2].closed = True
                    for name, *_ in open_[i:]:
                        if name in spans:
                            spans[name] -= 1
                    del open_[i:]
                    break
            continue
        if rest.endswith("/"):
            continue
        if inline:
            spans[tag] = spans.get(tag, 0) + 1
        if open_ and open_[-1][0] in _CLOSES.get(tag, ()):
            open_.pop()
        inside, around = open_[-1][1:3] if open_ else (OTHER, None)
        said = _declared(tag, rest)
        # A heading's <header> inside an article belongs to the article.
        if said == TEMPLATE and tag == "header" and inside in (ARTICLE, _ENCLOSED):
            said = None
        if said == TEMPLATE:
            around = _Around(tag, rest, around, inside)
            arounds.append(around)
        elif said == ARTICLE and _is_main(tag, rest):
            around = None
        elif said == ARTICLE and around is not None:
            said = _ENCLOSED
        open_.append((tag, inside if said is None else said, around, said == TEMPLATE))
    words.append(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", source[at:]))
    flush()
    return _decided(lines, arounds)


def shared_lines(own: list[str], other: list[str]) -> np.ndarray:
    """Which of ``own`` lie on a longest common subsequence with ``other``.

    Equal beginnings and ends always do. Between them bit-parallel: one bit a line of ``other``; a
    row's zero bits mark where the length grows. One row in a square root of them is stored, and those
    between are made again on the way back.
    """
    keep = np.zeros(len(own), bool)
    low, high = 0, min(len(own), len(other))
    while low < high and own[low] == other[low]:
        low += 1
    high, tail = high - low, 0
    while tail < high and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    keep[:low] = keep[len(own) - tail :] = True
    own, other = own[low : len(own) - tail], other[low : len(other) - tail]
    places: dict[str, int] = {}
    for i, line in enumerate(other):
        places[line] = places.get(line, 0) | (1 << i)
    full = (1 << len(other)) - 1
    step = math.isqrt(len(own)) + 1

    def rows(row: int, lines: list[str]) -> Iterator[int]:
        yield row
        for line in lines:
            both = row & places.get(line, 0)
            row = ((row + both) | (row - both)) & full
            yield row

    stored = list(islice(rows(full, own), 0, None, step))
    column = len(other)
    for block in range(len(stored) - 1, -1, -1):
        start = block * step
        near = list(rows(stored[block], own[start : start + step]))
        for i in range(len(near) - 2, -1, -1):
            # Length at (i, column) is the number of zero bits below column.
            below = (1 << column) - 1
            if (near[i + 1] & below).bit_count() < (near[i] & below).bit_count():
                keep[low + start + i] = True
                column = (places[own[start + i]] & below).bit_length() - 1  # the last match gives all of it
    return keep


def _nearness(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _difference(page: dict, mate: dict | None) -> str:
    """The lines that differencing leaves, then checked against what the page declares."""
    kinds = np.array(page["kinds"], int)
    if mate is None:
        left = np.full(len(kinds), ARTICLE not in page["kinds"])
    else:
        left = ~shared_lines(page["lines"], mate["lines"])
    kept = (left & (kinds != TEMPLATE)) | (kinds == ARTICLE)
    return " ".join(x for x, k in zip(page["lines"], kept, strict=True) if k)


def _mate(page: dict, before: dict | None, after: dict | None) -> dict | None:
    near = [m for m in (before, after) if m is not None and page["host"] and m["host"] == page["host"]]
    return max(near, key=lambda m: _nearness(page["path"], m["path"]), default=None)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in the order of their URLs; each waits until the next one that is no copy is known.

    A run is one page and its copies: every row has the URL or the lines of the row before it.
    """
    before: dict | None = None
    run: list[dict] = []

    def done(after: dict | None) -> Iterator[tuple]:
        made = against = None
        text = ""
        for page in run:
            mate = _mate(page, before, after)
            if made is None or page["lines"] is not made["lines"] or page["kinds"] is not made["kinds"] or mate is not against:
                made, against, text = page, mate, _difference(page, mate)
            yield page["page_id"], page["url"], text, len(text)

    def finished() -> Iterator[tuple]:
        nonlocal before, run
        for batch in batches:
            for page in batch.to_pylist():
                page["path"] = page["path"].split("/")
                if run:
                    last = run[-1]
                    copied = page["lines"] == last["lines"]
                    if copied and page["kinds"] == last["kinds"]:  # a run holds the lines of its copies once
                        page["lines"], page["kinds"] = last["lines"], last["kinds"]
                    if not (page["host"] and page["host"] == last["host"] and (copied or page["url"] == last["url"])):
                        yield from done(page)
                        before, run = last, []
                run.append(page)
        yield from done(None)

    rows = finished()
    while some := list(islice(rows, OUT_ROWS // 8)):
        yield _texts(some)


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    ids, urls, texts, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
        names=["page_id", "url", "text", "n_chars"],
    )


def _parsed(table: pa.Table):
    hosts, paths, kinds, lines = [], [], [], []
    for url, source in zip(table.column("url").to_pylist(), table.column("html").to_pylist(), strict=True):
        try:
            parts = urlsplit(url or "")
            hosts.append((parts.hostname or "").lower())
            paths.append(parts.path)
        except ValueError:
            hosts.append("")
            paths.append("")
        found = page_lines(source)
        kinds.append([k for k, _ in found])
        lines.append([x for _, x in found])
    return [
        pa.array(hosts, pa.string()),
        pa.array(paths, pa.string()),
        pa.array(kinds, pa.list_(pa.int32())),
        pa.array(lines, pa.list_(pa.string())),
    ]


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    parsed = with_arrow_columns(
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"),
        _parsed,
        "host string, path string, kinds array<int>, lines array<string>",
        size_of="html",
        keep=["page_id", "url"],
    )
    order = ["host", "path", "url", "page_id"]
    # Only neighbours matter: ranges by URL, equal URLs spread by id, sorted inside each range.
    return (
        parsed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
    )
