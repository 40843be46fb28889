"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams its events. Each event's text falls to the block that is open, and a block is one line of
the measure: the length of its text outside links against the tags in it. The ratios, in page order, are smoothed with a Gaussian
and cut into two clusters by the threshold that parts their logarithms best. The high lines select the content region in the
tree of containers: from the body downwards as long as one container holds nearly all of the high text, and no further than a
container with paragraphs or headings of its own, an ``article`` or a ``main``. What is low in that region (short paragraphs,
headings, lists) belongs to it; where no container stands out, the region runs from the first high line to the last.

Structure gives features, not the selection. No line is what stands in elements that HTML names for something else (menus, page headers, footers,
asides, forms, scripts, styles, dialogs, templates), is hidden, or stands in a block whose class, id or role has a name made up of nothing but
words for adverts, notices, comments and the like ("cookie-notice", not "content-notice-board").
Such a name is overruled, but for comments, by a block that holds an ``article``, a ``main`` or an ``h1``.

Defined results: null and empty html give the empty text. Repeated pages keep their rows. A column named ``text`` is replaced; other columns
stay. Broken markup is read as far as the parser goes: end tags without a start are passed over, open elements end where
HTML says, a tag that the page never ends takes the rest with it. Time and memory are linear in the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import small_batches

# Element names of HTML by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head title script style noscript template nav footer aside form button select option textarea label fieldset dialog menu iframe map".split())
_BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | _NEVER - {"title", "script", "style", "template", "button", "select", "option", "textarea", "label", "iframe", "map"}
_BOX = frozenset("article body center div main section td".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, and the elements around which that does not reach.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "body": (("head",), ("html",))}
# Words of names for what is not the article, words that may stand beside them, and those of readers' comments.
_OTHER = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo recommendations recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
_BESIDE = frozenset("area article bar block bottom box button buttons container form group holder inner item items left list main message outer page post posts right row section site slot text top unit widgets wrap wrapper".split())
_COMMENTS = frozenset("comment commentlist comments disqus replies reply respond".split())
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+|[^a-z0-9_-]+")
_MARKUP = re.compile(r"<[a-zA-Z/!?]")

SIGMA = 1.0
#: The share of the high text that a container must hold to be taken for its parent.
NEARLY_ALL = 0.8
_SLICE = 1 << 16


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters inside links
    box: int
    block: str  # the block element around the text


def named_for(value: str) -> str:
    """"comments", "other" or "": what a value of class, id or role says its block is for."""
    kind = ""
    for name in value.lower().split():
        words = _WORDS.findall(name)
        if words and _COMMENTS.intersection(words) and all(w in _COMMENTS or w in _BESIDE or w in _OTHER for w in words):
            return "comments"
        if words and _OTHER.intersection(words) and all(w in _OTHER or w in _BESIDE for w in words):
            kind = "other"
    return kind


class _Page(HTMLParser):
    """Collects lines in page order, and the tree of boxes (containers) that they stand in. Box 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.boxes: list[tuple[int, str, str]] = [(-1, "body", "")]  # parent, element, what it is named for
        self.open: list[tuple[str, bool, bool]] = []  # element, hidden, is a box
        self.places: dict[str, list[int]] = defaultdict(list)  # where each element is open
        self.blocks: list[int] = []  # where blocks are open
        self.inside = [0]  # boxes that are open
        self.hidden = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.inside[-1], self.open[self.blocks[-1]][0] if self.blocks else "body"))
        self.text, self.tags, self.linked = [], 0, 0

    def pop_to(self, place: int) -> None:
        while len(self.open) > place:
            name, hidden, box = self.open.pop()
            self.places[name].pop()
            if name in _BLOCK:
                self.blocks.pop()
            self.hidden -= hidden
            if box:
                self.inside.pop()

    def last(self, names: tuple[str, ...]) -> int:
        return max(self.places[n][-1] if self.places[n] else -1 for n in names)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
            # A paragraph that is the innermost block ends with the next block.
            if self.places["p"] and self.blocks[-1] == self.places["p"][-1]:
                self.pop_to(self.blocks[-1])
        elif tag == "br" and not self.hidden:
            self.text.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        if tag in _ENDS:
            at = self.last(_ENDS[tag][0])
            if at > self.last(_ENDS[tag][1]):
                self.pop_to(at)
        hidden, purpose = tag in _NEVER or (tag == "header" and not any(self.places[n] for n in ("article", "section", "main"))), ""
        if attrs:
            given = {k: v or "" for k, v in attrs}
            hidden = hidden or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
            if tag in _BLOCK and tag not in ("body", "html", "article", "main") and not self.hidden:
                said = {named_for(given.get(k, "")) for k in ("class", "id", "role")}
                purpose = "comments" if "comments" in said else "other" if "other" in said else ""
        box = tag in _BOX or bool(purpose)
        if box:
            self.boxes.append((self.inside[-1], tag, purpose))
            self.inside.append(len(self.boxes) - 1)
        self.places[tag].append(len(self.open))
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, hidden, box))
        self.hidden += hidden

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        # The end of an inline element does not end a block inside it.
        if tag in _BLOCK or tag in _NEVER or not self.blocks or self.blocks[-1] < at:
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.places["a"]:
                self.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...]>`` is a comment to HTML; the parser's own reading of it raises on unknown names."""
        return self.parse_bogus_comment(i, 0) if i >= 0 else i

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def read(self, html: str) -> None:
        """Feed in slices, which double while a construct stays open, so that what is read again stays linear."""
        at, size = 0, _SLICE
        while at < len(html):
            self.feed(html[at : at + size])
            at += size
            size = max(_SLICE, len(self.rawdata))
        # The parser's own end looks at each "<" of an open construct again; what HTML does is end the page there.
        if self.rawdata and not self.cdata_elem and not _MARKUP.match(self.rawdata):
            self.handle_data(unescape(self.rawdata))
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    if len(ratios) == 0:
        return ratios
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[r : r + len(ratios)]
    return np.convolve(ratios, kernel, mode="full")[r : r + len(ratios)] / weight


def high_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are in the upper of two clusters: the cut leaves the least spread inside both."""
    x = np.log1p(smoothed(ratios, sigma))
    s = np.sort(x)
    if len(s) == 0 or s[-1] - s[0] < 1e-9:
        return np.ones(len(x), dtype=bool)
    n = np.arange(1, len(s))
    total = s.cumsum()
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(s) - n)
    between = np.where(np.diff(s) > 0, n * (len(s) - n) * (high - low) ** 2, -1)
    return x >= s[int(between.argmax()) + 1]


def _outside(boxes: list[tuple[int, str, str]], lines: list[Line]) -> list[bool]:
    """Which boxes are named for something else than the article, or lie in such a box."""
    wraps = [name in ("article", "main") for _, name, _ in boxes]
    for x in lines:
        wraps[x.box] = wraps[x.box] or x.block == "h1"
    for i in range(len(boxes) - 1, 0, -1):
        if wraps[i]:
            wraps[boxes[i][0]] = True
    out = [False] * len(boxes)
    for i, (parent, _, purpose) in enumerate(boxes):
        out[i] = (parent >= 0 and out[parent]) or purpose == "comments" or (purpose == "other" and not wraps[i])
    return out


def content(lines: list[Line], boxes: list[tuple[int, str, str]], sigma: float = SIGMA) -> list[str]:
    """The texts of the lines of the content region."""
    gone = _outside(boxes, lines)
    lines = [x for x in lines if not gone[x.box]]
    if not lines:
        return []
    size, linked, tags = (np.array(v, dtype=float) for v in zip(*[(len(x.text), x.linked, x.tags) for x in lines], strict=True))
    high = high_lines(np.maximum(size - linked, 0) / np.maximum(tags, 1), sigma)
    box = np.array([x.box for x in lines])
    # Boxes are numbered as they open, so those inside box i are i + 1 .. last[i].
    last, mass, children = list(range(len(boxes))), np.bincount(box[high], weights=size[high], minlength=len(boxes)), defaultdict(list)
    for i in range(len(boxes) - 1, 0, -1):
        up = boxes[i][0]
        mass[up] += mass[i]
        last[up] = max(last[up], last[i])
        children[up].append(i)
    # Boxes with paragraphs, headings or items of their own, links aside.
    own = {x.box for x in lines if x.block not in _BOX and 2 * x.linked < len(x.text)}
    at = 0
    while boxes[at][1] not in ("article", "main") and (boxes[at][1] == "body" or at not in own) and children[at]:
        best = max(children[at], key=mass.__getitem__)
        if mass[best] <= 0 or mass[best] < NEARLY_ALL * mass[at]:
            break
        at = best
    inside = (box >= at) & (box <= last[at])
    if boxes[at][1] != "body" and (boxes[at][1] in ("article", "main") or at in own):
        keep = inside
    else:
        found = np.flatnonzero(inside & high)
        keep = np.zeros(len(lines), dtype=bool)
        if len(found):
            keep[found[0] : found[-1] + 1] = True
        for i in children[at]:
            if mass[i] > 0:
                keep |= (box >= i) & (box <= last[i])
        keep &= inside & (2 * linked < size)
    # Headings right before the region, in a box around it, are its title.
    around, up = set(), at
    while up >= 0:
        around.add(up)
        up = boxes[up][0]
    first = int(keep.argmax()) if keep.any() else 0
    while first and lines[first - 1].block in _HEADING and lines[first - 1].box in around:
        first -= 1
        keep[first] = True
    return [x.text for x, k in zip(lines, keep, strict=True) if k]


def main_text(html: str | None) -> str:
    page = _Page()
    page.read(html or "")
    return "\n\n".join(content(page.lines, page.boxes))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series([main_text(x) for x in h], dtype=object)

    return pages.withColumn("text", of("html"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
