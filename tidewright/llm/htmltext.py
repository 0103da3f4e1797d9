"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clusters of dense lines.

The standard library's parser is fed a page piece by piece. Its events become lines, one for each run
of text between block elements, with the tags met in it. A line's ratio is its characters outside links
for each tag; ratios are smoothed with a Gaussian over the page, and lines above a threshold form
clusters. The clusters decide which element holds the article; of that element all is kept but what
its tags, roles and names mark as something else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they do in HTML.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no text of an article.
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frameset head iframe input label math-annotation menu meter nav "
    "noembed noframes noscript object option output progress script select style svg template textarea title video".split()
)
#: Roles of such elements.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
#: Words of class names and ids that mark menus, notices, adverts and comments.
NAMES = frozenset(
    "ad ads adbox adsense advert advertisement adverts alert banner breadcrumb breadcrumbs byads captcha comment comments commentlist consent "
    "cookie cookiebar cookies copyright dfp dialog disclaimer disqus dropdown footer footnav form gdpr header login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup popover promo promoted promotion "
    "related replies reply respond responses search share sharing sidebar signup skip skyscraper social sponsor sponsored "
    "subscribe subscription subnav tagcloud teaser toolbar tooltip topbar topnav widget widgets".split()
)
#: In names with such a word, header and form are parts of the article; others do not speak of the element itself.
OF_ARTICLE = frozenset("article content entry page post section story title".split())
OF_LAYOUT = frozenset("has no with without".split())
_NAME = re.compile(r"[A-Za-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: Characters given to the parser at once; more if it holds them all back.
PIECE = 1 << 16
#: Lines on each side that the Gaussian takes in, and its standard deviation.
RADIUS, SIGMA = 2, 1.0
#: A line is dense if its smoothed ratio is above this share of the page's mean.
SHARE = 0.9


def marked(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether an element's role, name or style says that it holds something else than an article."""
    for key, value in attributes:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I):
            return True
        if key in ("class", "id") and tag not in ("html", "body", "main"):
            for name in value.split():
                words = {w.lower() for w in _NAME.findall(_CAMEL.sub(" ", name))}
                hits = words & NAMES
                if words & OF_ARTICLE:
                    hits -= {"header", "form", "related"}
                if hits and not words & OF_LAYOUT:
                    return True
    return False


class Lines(HTMLParser):
    """The lines of a page: text, tags, characters in links, whether dropped, and elements they lie in.

    Elements of the page are numbered in order; `parents` has each one's parent and `roots` those of
    articles. Only block elements and marked ones are on the stack, so a page of any depth is read
    in time that grows with its length.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.dropped: list[bool] = []
        self.inside: list[int] = []
        self.parents: list[int] = [-1]
        self.roots: list[int] = []
        self._stack: list[tuple[str, int, bool]] = []  # tag, element, whether it is dropped
        self._open: Counter[str] = Counter()
        self._gone = 0
        self._unread = 0  # open dropped elements that are no blocks: their text belongs to no line
        self._link = False
        self._parts: list[str] = []
        self._tags = self._linked = 0

    def line(self) -> None:
        """Ends a line; white space becomes single spaces."""
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            self.texts.append(text)
            self.tags.append(self._tags)
            self.linked.append(self._linked)
            self.dropped.append(self._gone > 0)
            self.inside.append(self._stack[-1][1] if self._stack else 0)
            self._tags = 0
        self._parts, self._linked = [], 0

    def _pop(self) -> None:
        tag, _, gone = self._stack.pop()
        self._open[tag] -= 1
        self._gone -= gone
        self._unread -= gone and tag not in BLOCK

    def _close(self, tag: str) -> None:
        """Ends the last open element of that tag and all in it."""
        while self._stack[-1][0] != tag:
            self._pop()
        self._pop()

    def _implied(self, tag: str) -> None:
        """A block ends an open paragraph, an item or cell the one before it."""
        while self._stack and (top := self._stack[-1][0]) not in BLOCK and self._open["p"]:
            self._pop()
        if not self._stack:
            return
        top = self._stack[-1][0]
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
        if top == "p":
            self._pop()
            top = self._stack[-1][0] if self._stack else ""
        for _ in range(2):
            if top in ends.get(tag, ()):
                self._pop()
                top = self._stack[-1][0] if self._stack else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self.line()
            self._implied(tag)
            self._link = False
        elif tag == "br":
            self._parts.append(" ")
        self._tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self._link = True
        if tag == "body":  # ends a head that was left open
            while self._open["head"]:
                self._pop()
        in_article = self._open["article"] > 0 or self._open["main"] > 0
        gone = tag in NEVER and not (tag == "footer" and self._open["blockquote"]) or tag == "header" and not in_article or marked(tag, attrs)
        if not (block or gone or self._gone):
            return
        if tag in ("article", "main") and not gone and self._gone and all(t == "form" or not g for t, _, g in self._stack[-64:]) and self._gone <= 64:
            # a form around the whole page
            self._stack = [(t, e, False) for t, e, _ in self._stack]
            self._gone = 0
        element = self._stack[-1][1] if self._stack else 0
        if block:
            self.parents.append(element)
            element = len(self.parents) - 1
            if tag in ("article", "main") and not gone and not self._gone:
                self.roots.append(element)
        self._stack.append((tag, element, gone))
        self._open[tag] += 1
        self._gone += gone
        self._unread += gone and not block

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no empty elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK:
            self.line()
            self._link = False
        elif tag == "a":
            self._link = False
        if self._open[tag]:
            if tag not in BLOCK:  # an inline element ends within its block
                i = len(self._stack) - 1
                while self._stack[i][0] != tag and self._stack[i][0] not in BLOCK:
                    i -= 1
                if self._stack[i][0] != tag and tag not in NEVER:
                    return
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._unread:
            self._parts.append(data)
            if self._link:
                self._linked += len(data)


def parsed(html: str) -> Lines:
    """The lines of a whole page, read piece by piece."""
    lines, at, size = Lines(), 0, PIECE
    while at < len(html):
        lines.feed(html[at : at + size])
        at += size
        # what the parser holds back is read again with the next piece, so that piece must not be small against it
        size = max(PIECE, 2 * len(lines.rawdata))
    if lines.cdata_elem is None and not re.match("<[A-Za-z/!?]", lines.rawdata):  # a tag that is cut off is no text
        lines.close()
    lines.line()
    return lines


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Ratios under a Gaussian of 2 * radius + 1 lines; the page's ends count as ratio 0."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratios, weights / weights.sum())[radius : radius + len(ratios)]


def _above(element: int, parents: list[int], wanted: set[int]) -> int:
    while element not in wanted and element >= 0:
        element = parents[element]
    return element


def content(lines: Lines, share: float = SHARE) -> np.ndarray:
    """Which lines are the article.

    Dense lines are those whose smoothed ratio is above `share` times the mean. Of the outermost article
    and main elements, those with dense lines are kept, or the one with most text if none has any.
    On a page without them it is the smallest element that holds over half of the dense lines' text, each
    line from the first to the last dense one, headings that lead to the first one and lines that are no lists of links.
    """
    n = len(lines.texts)
    size = np.array([len(t) for t in lines.texts], np.int64)
    own = np.maximum(size - np.array(lines.linked, np.int64), 0)
    alive = ~np.array(lines.dropped, bool)
    if not alive.any():
        return alive
    smooth = smoothed(own / np.maximum(1, np.array(lines.tags)))
    dense = alive & (smooth >= share * smooth.mean())
    if not dense.any():
        dense = alive
    inside, parents = lines.inside, lines.parents
    if lines.roots:
        outer: set[int] = set()
        depth_first = sorted(lines.roots)  # an element's number is above its ancestors'
        within = np.full(len(parents), -1, np.int64)  # the outermost root that an element lies in
        roots = set(depth_first)
        for e in range(1, len(parents)):
            up = within[parents[e]]
            within[e] = up if up >= 0 else (e if e in roots else -1)
        of = within[np.array(inside)]
        here = alive & (of >= 0)
        if here.any():
            outer = set(of[here & dense].tolist())
            if not outer:
                mass = np.bincount(of[here], weights=own[here])
                outer = {int(mass.argmax())}
            # an article inside main, where main also holds other things: the articles are the content
            articles = [r for r in depth_first if within[r] in outer and r not in outer]
            if articles:
                nested = np.zeros(len(parents), bool)
                nested[articles] = True
                for e in range(1, len(parents)):
                    nested[e] |= nested[parents[e]]
                inner = here & nested[np.array(inside)]
                if own[inner & dense].sum() > 0.5 * own[here & dense].sum():
                    return inner
            return here & np.isin(of, list(outer))
    # no article element: text of dense lines under each element, from the leaves up
    mass = np.zeros(len(parents))
    np.add.at(mass, np.array(inside)[dense], own[dense] + 1)
    for e in range(len(parents) - 1, 0, -1):
        mass[parents[e]] += mass[e]
    best = max((e for e in range(len(parents)) if mass[e] > 0.5 * mass[0]), default=0)
    # a paragraph that holds over half of the text stands in the element of the article
    direct = Counter(inside[i] for i in np.flatnonzero(dense))
    if best and direct[best] and mass[best] < mass[0]:
        best = parents[best]
    under = np.zeros(len(parents), bool)
    under[best] = True
    for e in range(1, len(parents)):
        under[e] |= under[parents[e]]
    here = alive & under[np.array(inside)]
    core = np.flatnonzero(here & dense)
    first, last = int(core[0]), int(core[-1])
    links = 2 * np.array(lines.linked, np.int64) > size
    while first and here[first - 1] and not links[first - 1]:
        first -= 1
    while last + 1 < n and here[last + 1] and not links[last + 1]:
        last += 1
    place = np.arange(n)
    return here & (place >= first) & (place <= last) & ~(links & ~dense)


def main_text(html: str | None, share: float = SHARE) -> str:
    """The text of a page's article; empty if there is none."""
    if not html:
        return ""
    lines = parsed(html)
    keep = content(lines, share) if lines.texts else []
    return " ".join(t for t, k in zip(lines.texts, keep) if k)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), share: float = SHARE) -> DataFrame:
    """keep, text, n_chars (code points) of each row of pages: the main text of its whole html.

    Null and empty html give an empty text, and so does a page without text. Character references are
    decoded; white space (Unicode's) within a block becomes one space; blocks are joined by one
    space in page order. Tags that are not closed, not opened or cut off at the end are borne as browsers bear
    them. Rows are independent: repeated rows are repeated, an empty table gives none, and other columns are not read.
    """
    source = pages.select(*keep, html)
    names = [f.name for f in source.schema.fields[:-1]] + ["text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), share) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.withColumn(html, F.col(html).cast("string")).mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars long")
