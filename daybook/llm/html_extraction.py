"""Main text of web pages from streaming parser events.

Method: the standard library's ``HTMLParser`` streams events into blocks ("lines").
Each block has a text-to-tag ratio: its characters over one plus its tags. The
ratios are smoothed with a Gaussian kernel along each region, weighted by what the markup says of
the block's place, and split into two clusters by an iterated mean threshold;
the regions with a block in the high cluster are the article.

A region is what stands in one ``<article>`` or ``<main>``, else in one
container (``div``, ``section``, table cell, page). Markup alone selects nothing:
an ``<article>`` weighs the more the larger its share of the text is, and a
container whose class or id is that of an advert, sidebar or comments weighs
little, inside an article a quarter. An article whose best block comes near that
of a chosen article is chosen too, so two kinds of main text are not told apart. Only elements that never hold an article (menus,
forms, scripts, ...) and hidden ones take part in no region.

Defined results: a null or empty page gives an empty text, as does one with
nothing outside menus, forms and marked containers; repeated rows give repeated
results; other columns stay as they are when ``extract_pages`` is used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
NEVER_CONTENT = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map nav menu footer aside form "
    "button select textarea input option optgroup datalist fieldset dialog search header".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("head html body title".split())
HOLDERS = frozenset("article main".split())
CONTAINERS = frozenset("article main section div table td th tr ul ol dl details body html".split())
#: Containers that a class may mark; other elements, headings and paragraphs among them, keep their text whatever their class.
MARKABLE = frozenset("div section ul ol dl table td details span".split())
#: Roles of parts that are not the article.
OTHER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Class names of other parts: as a whole, or as first or last word of a name with hyphens or underscores.
OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer sidebar sidebars widget widgets comment comments respond replies disqus cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar".split()
)
#: Class names of other parts only as a whole.
OTHER_NAMES = frozenset("header site-header page-header masthead search form legal copyright disclaimer alert alerts discussion hidden visually-hidden sr-only skip-link".split())

#: Weights of a block's score by its place: an article with all and with none of the text, marked parts outside and inside an article.
ALL_TEXT, NO_TEXT, MARKED, MARKED_INSIDE = 4.0, 0.2, 0.05, 0.25
#: An article is as good as a chosen one if its best score, so many times, reaches that one's.
NEAR = 4.0


def other_part(classes: str, place: str = "") -> bool:
    """Whether a class attribute, or an id, names an advert, menu, sidebar, comment list or the like. Ids count by their words only, as whole names are often those of chapters."""
    for name in (*classes.lower().split(), *place.lower().split()):
        words = re.split("[-_]+", name)
        if (name in OTHER_NAMES and name in classes.lower().split()) or words[0] in OTHER_PARTS or words[-1] in OTHER_PARTS:
            return True
    return False


class _State(NamedTuple):
    """What holds for the text inside an element: excluded, number of the article it stands in, number of its container, marked."""

    excluded: bool = False
    holder: int = 0
    container: int = 0
    marked: bool = False


class _Block(NamedTuple):
    text: str
    tags: int
    place: _State


class _Blocks(HTMLParser):
    """Collects the blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, _State]] = []
        self.n_open: Counter[str] = Counter()
        self.blocks: list[_Block] = []
        self.parts: list[str] = []
        self.tags = 0
        self.holders = 0
        self.containers = 0

    def _state(self) -> _State:
        return self.open[-1][1] if self.open else _State()

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(_Block(text, self.tags, self._state()))
            self.tags = 0
        self.parts = []

    def _shut(self, at: int) -> None:
        """The open elements from a place on end."""
        for name, _ in self.open[at:]:
            self.n_open[name] -= 1
        del self.open[at:]

    def _close(self, name: str) -> None:
        if not self.n_open[name]:  # an end tag without its element costs nothing
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == name:
                if name in BLOCKS or any(x[1].excluded or x[1].marked for x in self.open[at:]):
                    self._cut()
                self._shut(at)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ENDS_PARAGRAPH:
            for at in range(len(self.open) - 1, -1, -1):  # an open paragraph ends where a block begins
                if self.open[at][0] == "p":
                    self._cut()
                    self._shut(at)
                    break
                if self.open[at][0] in BLOCKS:
                    break
        if tag == "li" or tag in ("dt", "dd", "tr", "td", "th", "option"):
            kin = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in kin:
                    self._cut()
                    self._shut(at)
                    break
                if self.open[at][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
        now = self._state()
        apart = tag in NEVER_CONTENT and not (tag == "header" and now.holder)
        marked = now.marked
        if attrs and not apart:
            given = {k: v or "" for k, v in attrs}
            apart = given.get("role", "").lower() in OTHER_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            apart = apart or "display:none" in given.get("style", "").replace(" ", "").lower()
            marked = marked or tag in MARKABLE and other_part(given.get("class", ""), given.get("id", ""))
        if tag in BLOCKS or (apart, marked) != (False, now.marked):
            self._cut()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        holder, container = now.holder, now.container
        if tag in HOLDERS and not now.excluded and not holder:
            self.holders += 1
            holder, marked = self.holders, False
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        self.n_open[tag] += 1
        self.open.append((tag, _State(now.excluded or apart, holder, container, marked)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash except on void elements

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the kernel is renormalised."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, mode="full")[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def two_clusters(values: np.ndarray) -> float:
    """Threshold between a low and a high cluster: the mean of both means, iterated till it rests."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return cut
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            return new
        cut = new
    return cut


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of one page, its blocks joined by two line feeds."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._cut()
    blocks = parser.blocks
    plain = [b for b in blocks if not b.place.excluded and not b.place.marked]
    if not plain:
        return ""
    ratios = np.array([0.0 if b.place.excluded else len(b.text) / (1 + b.tags) for b in blocks])
    region = lambda b: (True, b.place.holder) if b.place.holder else (False, b.place.container)
    lines: dict[tuple[bool, int], list[int]] = {}
    for i, b in enumerate(blocks):
        lines.setdefault(region(b), []).append(i)
    score = np.empty(len(blocks))
    for at in lines.values():  # along the lines of a region, so that its neighbours don't shine in
        score[at] = smoothed(ratios[at], sigma)
    score *= weights(blocks)
    high = score >= two_clusters(score)
    chosen = {region(b) for b, yes in zip(blocks, high, strict=True) if yes and not b.place.excluded}
    best: dict[tuple[bool, int], float] = {}
    for b, x in zip(blocks, score, strict=True):
        if b.place.holder and not b.place.excluded and not b.place.marked:
            best[region(b)] = max(best.get(region(b), 0.0), float(x))
    least = min((x for r, x in best.items() if r in chosen), default=math.inf)
    chosen |= {r for r, x in best.items() if x * NEAR >= least}
    # A marked part of an article stays only if the clusters speak for it.
    kept = [b.text for b, yes in zip(blocks, high, strict=True) if not b.place.excluded and region(b) in chosen and (yes or not b.place.marked)]
    return "\n\n".join(kept)


def weights(blocks: list[_Block]) -> np.ndarray:
    """How much each block's score counts, by the markup around it."""
    held: dict[int, int] = {}
    for b in blocks:
        if not b.place.excluded and not b.place.marked:
            held[b.place.holder] = held.get(b.place.holder, 0) + len(b.text)
    total = sum(held.values())

    def weight(b: _Block) -> float:
        if b.place.excluded:
            return 0.0
        if not b.place.holder:
            return MARKED if b.place.marked else 1.0
        own = NO_TEXT + (ALL_TEXT - NO_TEXT) * (held.get(b.place.holder, 0) / max(total, 1)) ** 2
        return own * MARKED_INSIDE if b.place.marked else own

    return np.array([weight(b) for b in blocks])


def extract_pages(pages: DataFrame, html: str = "html", into: str = "text", sigma: float = 1.0) -> DataFrame:
    """``pages`` with the main text of each page's whole html in ``into``."""

    def batches(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([main_text(x if isinstance(x, str) else None, sigma) for x in s], dtype=object)

    run = F.pandas_udf(batches, "string")
    return pages.withColumn(into, run(F.col(html)))
