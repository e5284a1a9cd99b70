"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Parser events of the standard library are cut into lines at block tags. A line's
text-to-tag ratio, less its share of link text and less for text that stands bare in a
container instead of in a text element, is smoothed over its neighbours with a Gaussian; a
threshold between the two clusters of smoothed ratios marks content lines (all of them where
the clusters lie too close together to tell). If most of the marked text stands in article elements, or else in a main
element, these are the regions. Otherwise the region is the smallest container with most of the marked text, and what
stands beside it counts too where the ratios mark it or where it is text elements next to the region, such as
other sections of an article. Of a region every line counts that no boilerplate element holds and that isn't links,
so short paragraphs between long ones stay; headings next to marked lines count.

Boilerplate elements are those whose tag, role, or class and id words say so: menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, styles,
comments of readers.

Cases: null or empty html and pages without content give the empty string; unclosed
tags end where HTML ends them or at their parent's end; broken markup is read as the
standard parser reads it; very long and very deep pages are processed whole, in time that grows with their length; repeated rows give
equal rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea option iframe object svg math canvas audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class and id attributes that name boilerplate.
NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial banner sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar footer comment comments commentlist disqus discussion replies respond share sharing social related recommended"
    " newsletter subscribe subscription signup login search widget skip".split()
)
ASIDE_ARTICLES = frozenset("comment reply related recommended promo ad advert sponsored".split())
TOPS = frozenset("header masthead topbar".split())
KEPT = frozenset("html body main article".split())
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARE = 0.2  # how much bare text counts
CLOSE = 0.2  # clusters whose mean ratios differ by less than about a fifth are one
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
ITEM_HOLDERS = frozenset("ul ol dl table div".split())
ENDS_P = BLOCKS - frozenset(["br", "html", "body", "head", "title"])
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")


class Line:
    __slots__ = ("parts", "tags", "container", "dropped", "linked", "size", "kind")

    def __init__(self, container: int, dropped: bool, kind: str = ""):
        self.parts: list[str] = []
        self.tags, self.container, self.dropped, self.linked, self.size, self.kind = 0, container, dropped, 0, 0, kind

    @property
    def links(self) -> bool:
        return self.linked >= 0.7 * self.size

    @property
    def ratio(self) -> float:
        """Characters to a tag, less links and bare text."""
        return 0.0 if self.dropped else (self.size - self.linked) / max(1, self.tags) * (1.0 if self.kind else BARE)


class Open(NamedTuple):
    """An open element, with what holds inside it."""

    tag: str = ""
    dropped: bool = False  # here or above
    container: int = 0
    kind: str = ""  # the text element that bare text here belongs to
    article: bool = False  # in an article or main element
    barred: bool = False  # in an element whose tag alone is boilerplate


class Events(HTMLParser):
    """Lines of a page, each with its tag count and the container it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = [Open()]
        self.count: Counter[str] = Counter()  # open elements by tag
        self.parent: list[int] = [-1]
        self.kind: list[str] = ["page"]
        self.links = 0
        self.lines: list[Line] = [Line(0, False)]

    @property
    def _top(self) -> Open:
        return self.stack[-1]

    def _pop(self, k: int) -> None:
        self.count.subtract(x.tag for x in self.stack[k:])
        del self.stack[k:]

    def _line(self) -> None:
        top, last = self._top, self.lines[-1]
        if last.parts:
            self.lines.append(Line(top.container, top.dropped, top.kind))
        else:
            last.container, last.dropped, last.kind = top.container, top.dropped, top.kind

    def _names_boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        inside = self._top.article
        if tag == "header" and not inside:
            return True
        found = dict(attrs)
        if tag == "article":  # a card or comment in its own right; longer names may only speak of what it has
            return not ASIDE_ARTICLES.isdisjoint((found.get("class") or "").lower().split())
        if tag in KEPT or not attrs:
            return False
        if (found.get("role") or "").lower() in ROLES or "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or "display:none" in (found.get("style") or "").replace(" ", "").lower():
            return True
        named = f"{found.get('class') or ''} {found.get('id') or ''}"
        words = {w.lower() for w in WORDS.findall(named)} if named != " " else set()
        return bool(words & NAMES or not inside and words & TOPS)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and any(x.tag == "p" for x in self.stack[-6:]):
            self._close("p", stop=CONTAINERS)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, stop=ITEM_HOLDERS)
        if tag in ("article", "main") and self._top.dropped and not self._top.barred:
            # An advert or notice that was never closed doesn't hold the article.
            k = len(self.stack)
            while self.stack[k - 1].dropped:
                k -= 1
            self._pop(k)
        up = self._top
        dropped = up.dropped
        if tag not in VOID:
            dropped = dropped or self._names_boilerplate(tag, attrs)
            container = up.container
            if tag in CONTAINERS:
                self.parent.append(container)
                self.kind.append(tag)
                container = len(self.parent) - 1
            above = up.kind if container == up.container else up.tag if up.tag in TEXT_ELEMENTS else ""
            self.stack.append(Open(tag, dropped, container, tag if tag in TEXT_ELEMENTS else above, up.article or tag in ("article", "main"), up.barred or tag in DROPPED))
            self.count[tag] += 1
        self.links += tag == "a"
        if tag in BLOCKS or dropped != self.lines[-1].dropped:
            self._line()
        self.lines[-1].tags += 1

    handle_startendtag = handle_starttag

    def _close(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        if not self.count[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._pop(k)
                return
            if self.stack[k].tag in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        self.links = max(0, self.links - (tag == "a"))
        if tag not in VOID:
            self._close(tag, stop=frozenset() if tag in BLOCKS else CONTAINERS)
        if tag in BLOCKS or self._top.dropped != self.lines[-1].dropped:
            self._line()

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        line.parts.append(data)
        n = len(data.strip())
        line.size += n
        line.linked += n if self.links else 0


def smoothed(ratios: np.ndarray, sigma: float = 1.0, reach: int = 3) -> np.ndarray:
    """Gaussian smoothing with weights that are normalised at the ends."""
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, weights, "full")[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), weights, "full")[reach : reach + len(ratios)]


def cluster_marks(values: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Which values belong to the upper of two clusters of their logarithms (1-d two-means from the extremes); all, where the means are closer than CLOSE."""
    logs = np.log1p(values)
    low, high = logs.min(), logs.max()
    for _ in range(rounds):
        cut = (low + high) / 2
        a, b = logs[logs <= cut], logs[logs > cut]
        if not len(a) or not len(b):
            break
        low, high = a.mean(), b.mean()
    return logs >= (low + high) / 2 if high - low >= CLOSE else np.ones(len(values), bool)


def subtree_sums(parent: list[int], own: dict[int, int]) -> list[int]:
    """Per container what it and the containers inside it hold; parents come first."""
    out = [own.get(c, 0) for c in range(len(parent))]
    for c in range(len(parent) - 1, 0, -1):
        out[parent[c]] += out[c]
    return out


def within(parent: list[int], tops: set[int]) -> list[bool]:
    """Per container whether it is one of tops or inside one."""
    out: list[bool] = []
    for c, up in enumerate(parent):
        out.append(c in tops or up >= 0 and out[up])
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    events = Events()
    events.feed(html)
    events.close()
    lines = [x for x in events.lines if x.size]
    if not lines:
        return ""
    able = np.array([not x.dropped and not x.links for x in lines])
    marked = cluster_marks(smoothed(np.array([x.ratio for x in lines]))) & able
    for k, x in enumerate(lines):  # headings next to content
        if x.kind in HEADINGS and able[k] and marked[max(0, k - 1) : k + 3].any():
            marked[k] = True
    own: dict[int, int] = {}
    total = bare = 0
    for x in (x for x, m in zip(lines, marked, strict=True) if m):
        total += x.size
        bare += x.size * (not x.kind)
        own[x.container] = own.get(x.container, 0) + x.size
    if not total:
        return ""
    weight = subtree_sums(events.parent, own)
    for kind in ("article", "main"):
        tops = {c for c, k in enumerate(events.kind) if k == kind}
        inside = within(events.parent, tops)
        if 2 * sum(n for c, n in own.items() if inside[c]) > total:
            return joined_text(x for x in lines if not x.dropped and inside[x.container])
    # The smallest container with most of the marked text: children come after their parents.
    region = max(c for c, w in enumerate(weight) if 2 * w > total)
    inside = within(events.parent, {region})
    beside = within(events.parent, {max(0, events.parent[region])})  # sections next to the region
    told = {x.container for x, m in zip(lines, marked, strict=True) if m and (x.kind or 2 * bare > total)}
    return joined_text(x for x, m, ok in zip(lines, marked, able, strict=True) if ok and (inside[x.container] or x.kind and beside[x.container] or x.container in told and (m or x.kind)))


def joined_text(lines: Iterable[Line]) -> str:
    return " ".join(t for t in (SPACES.sub(" ", "".join(x.parts)).strip() for x in lines) if t)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
