"""Main text of web pages from parser events and text-to-tag ratios.

`html.parser` streams events of a page; nothing like a document tree is built.  Block-level tags cut
the text into lines, each with its number of characters and tags and the section it stands in.  The
text-to-tag ratios of the lines are smoothed by a Gaussian, and lines at or above a threshold (a share
of their standard deviation, never more than the largest) form the content cluster.  A section with a
line of the cluster is content as a whole, so its short paragraphs stay.  Lines inside menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, told by element, role, class or id,
count in the ratios as boilerplate and are never returned.  If the page marks an article, only sections
in it are content.

Edge cases: null and empty pages give an empty text; unclosed and crossing tags close with the next
block or their parent; text outside any tag is a line; very long pages are read whole; repeated rows are
read each; pages without id or url keep nulls there; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p "
    "pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements whose text is one section for the clusters.
SECTION = frozenset("article body div main section td html".split())
#: Elements that a new block closes if they are open.
LOOSE = {"p": BLOCK - {"br", "button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
         "th": {"td", "th", "tr"}, "option": {"option"}}
#: Text of these is no text of the page.
HIDDEN = frozenset("script style template noscript head title iframe svg object canvas select textarea math".split())
#: Boilerplate by element.
FRAME = frozenset("nav aside footer form menu button dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Boilerplate by a word of class or id.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu "
    "menus breadcrumb breadcrumbs pagination pager sidebar aside related recommended share sharing social "
    "comment comments commentlist disqus reply replies respond footer masthead topbar toolbar skip".split())
SMOOTH = 1.0
THRESHOLD = 0.5


class _Lines(HTMLParser):
    """Lines of a page: text, tags, section, inside an article, boilerplate."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, hidden, boilerplate, within an article
        self.sections = [0]
        self.made = 0
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.text: list[str] = []
        self.tags = 0
        self.state = (False, False, False)

    def end_line(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            hidden, frame, article = self.state
            if not hidden:
                self.lines.append((words, self.tags, self.sections[-1], article, frame))
            self.tags = 0
        self.text = []

    def _state(self) -> None:
        self.state = self.open[-1][1:] if self.open else (False, False, False)

    def _close(self, place: int) -> None:
        """Closes the open element at `place` and all inside it."""
        for tag, *_ in self.open[place:]:
            if tag in SECTION:
                self.sections.pop()
        del self.open[place:]
        self._state()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            for place in range(len(self.open) - 1, -1, -1):
                held = self.open[place][0]
                if tag in LOOSE.get(held, ()):
                    self._close(place)
                    break
                if held in BLOCK and held not in LOOSE:
                    break
        self.tags += 1
        if tag in VOID:
            return
        hidden, frame, article = self.state
        named = dict(attrs)
        words = set(re.findall(r"[a-z]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower()))
        frame = (frame or tag in FRAME or tag == "header" and not article or bool(words & NAMES)
                 and tag not in ("html", "body", "article", "main") or (named.get("role") or "").lower() in ROLES)
        hidden = hidden or tag in HIDDEN or "hidden" in named
        self.open.append((tag, hidden, frame, article or tag in ("article", "main")))
        if tag in SECTION:
            self.made += 1
            self.sections.append(self.made)
        self._state()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "iframe", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                self._close(place)
                break
            if self.open[place][0] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "div"):
                break  # a stray end tag does not close its surroundings

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.text.append(data)


def _smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = np.arange(-3, 4)
    weight = np.exp(-0.5 * (reach / SMOOTH) ** 2)
    padded = np.pad(ratio, 3, mode="edge")
    return np.convolve(padded, weight / weight.sum(), "valid")


def main_text(html: str | None) -> str:
    """The article of a page, one line for each block."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    text, tags, section, article, frame = zip(*page.lines, strict=True)
    size = np.array([len(t) for t in text], float)
    frame = np.array(frame)
    ratio = np.where(frame, 0.0, size / np.maximum(1, np.array(tags)))
    limit = THRESHOLD * ratio.std()
    ratio = _smoothed(ratio)
    usable = ~frame
    if (usable & np.array(article)).any():
        usable &= np.array(article)
    if not usable.any():
        return ""
    section = np.array(section)
    dense = usable & (ratio >= min(limit, ratio[usable].max()))
    # A marked article is one region; elsewhere each section stands for itself.
    kept = usable & (np.array(article) | np.isin(section, section[dense]))
    return "\n".join(t for t, k in zip(text, kept, strict=True) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "html"):
            text = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")
