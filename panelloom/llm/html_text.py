"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block, with elements that never hold the article left out. Text
lengths (without links) are summed over sliding windows of lines; the first surge and the last dive mark the ends of
the article, and all lines between stay. What a page marks as its article weighs a little more and takes nothing from
the lines outside.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their part in a page.
_RAW = frozenset("script style noscript template textarea iframe object svg math canvas".split())
_CHROME = frozenset("head nav footer aside form button select dialog menu audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCKS - frozenset("td th tr tbody thead tfoot caption html body option optgroup legend summary figcaption".split())
#: Words of class, id and role that mark what isn't the article.
_MARKS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr menu nav navbar navigation "
    "sidebar breadcrumb breadcrumbs footer comment comments respond replies disqus share sharing social related recommended newsletter subscribe subscription popup modal "
    "widget toolbar pagination pager skip login signup search masthead topbar".split()
)
#: A quote opens a value right behind = only: elsewhere it's a character like any other.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*+)(>|(?=<)|$)|<[!?][^>]*(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements whose end tag may be left out: the next of their kind ends them.
_IMPLIED = frozenset("p li dt dd option".split())
_LISTS = frozenset("ul ol dl select".split())
#: Elements whose end ends a paragraph that is open in them.
_HOLDS_P = frozenset("ul ol dl div article section main blockquote figure details".split())
_WHITE = re.compile(r"\s+")


#: A marked element with more than this share of a page's text is a wrapper; so is one that holds the page's main part.
_WRAPS = {"article": 0.3, "": 0.9}


@dataclass
class Line:
    text: str
    #: Characters that aren't in links.
    weight: int
    heading: bool
    inside: bool
    #: Number of the innermost marked element around it, -1 if there is none.
    mark: int = -1


@dataclass
class Mark:
    name: str
    #: Number of the marked element around this one.
    parent: int
    #: Open elements of its name where it starts; for one whose end tag may be left out, open lists.
    level: int
    wraps: bool = False
    held: int = 0


class Marks:
    """The marked elements of a page, and which of them are open: a tag costs the same however deep they are nested."""

    def __init__(self) -> None:
        self.all: list[Mark] = []
        self.around: list[int] = []
        self.loose: list[int] = []  # those whose end tag may be left out
        self.at: dict[tuple[str, int], int] = {}
        self.opened: dict[str, int] = {}
        self.lists = 0

    @property
    def inner(self) -> int:
        return self.around[-1] if self.around else -1

    def _end(self, k: int) -> None:
        while self.around and self.around[-1] >= k:
            m = self.all[self.around.pop()]
            self.at.pop((m.name, m.level), None)
        while self.loose and self.loose[-1] >= k:
            self.loose.pop()

    def ends(self, name: str, closing: bool) -> int:
        """The open marked element that this tag ends, with all in it; -1 if none."""
        if self.loose:
            m = self.all[self.loose[-1]]
            if m.name == "p":
                over = name == "p" or name in _CLOSES_P and (not closing or name in _HOLDS_P)
            else:
                over = self.lists == m.level and (name == m.name or closing and name in _LISTS)
            if over:
                return self.loose[-1]
        return self.at.get((name, self.opened.get(name, 0)), -1) if closing else -1

    def step(self, name: str, closing: bool, marked: bool) -> None:
        k = self.ends(name, closing)
        if k >= 0:
            self._end(k)
        if name in _LISTS:
            self.lists = max(0, self.lists + (-1 if closing else 1))
        if name not in _IMPLIED:
            self.opened[name] = max(0, self.opened.get(name, 0) + (-1 if closing else 1))
        if marked:
            k = len(self.all)
            self.all.append(Mark(name, self.inner, self.lists if name in _IMPLIED else self.opened[name]))
            self.around.append(k)
            if name in _IMPLIED:
                self.loose.append(k)
            else:
                self.at[name, self.opened[name]] = k

    def gone(self, lines: list[Line]) -> list[bool]:
        """Which marked elements are left out: those that don't wrap the page, and all in them."""
        for x in lines:
            if x.mark >= 0:
                self.all[x.mark].held += len(x.text)
        for m in reversed(self.all):
            if m.parent >= 0:
                self.all[m.parent].held += m.held
                self.all[m.parent].wraps |= m.wraps
        total = sum(len(x.text) for x in lines)
        out: list[bool] = []
        for m in self.all:
            out.append(m.parent >= 0 and out[m.parent] or not m.wraps and m.held <= _WRAPS.get(m.name, _WRAPS[""]) * total)
        return out


def _marked(attributes: str) -> bool:
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        value = entities.unescape(a or b or c)
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
        if any(w in _MARKS for w in re.split(r"[^a-z0-9]+", value)):
            return True
    return "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None


def lines_of(html: str) -> list[Line]:
    """The page's lines in order, chrome left out.

    Elements whose name says so are left out at once. Those that a class, id or role marks are left out when the page has been read, unless they wrap it:
    a mark such as has-sidebar on the element around everything says nothing.
    """
    lines: list[Line] = []
    text: list[str] = []
    in_link = 0
    link = articles = 0
    heading = False
    skip, depth = "", 0  # the element being left out, and how many of its name are open
    marks = Marks()
    at = 0

    def flush() -> None:
        nonlocal text, in_link
        line = _WHITE.sub(" ", entities.unescape("".join(text))).strip()
        if line:
            lines.append(Line(line, max(0, len(line) - in_link), heading, articles > 0, marks.inner))
        text, in_link = [], 0

    def put(piece: str) -> None:
        nonlocal in_link
        if piece and not skip:
            text.append(piece)
            if link:
                in_link += len(_WHITE.sub(" ", entities.unescape(piece)).strip())

    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = bool(m.group(1)), m.group(3)
        if skip:
            if name == skip:
                depth += -1 if closing else 1
            if depth > 0:
                if not closing and name in _RAW:
                    at = _raw_end(html, name, at)
                continue
            skip = ""
            continue
        if name in _RAW:
            if not closing:
                at = _raw_end(html, name, at)
            continue
        leave_out = not closing and (name in _CHROME or (name == "header" and not articles))
        marked = not closing and not leave_out and name not in _VOID and name not in ("html", "body", "main") and _marked(attributes)
        if name in _BLOCKS or leave_out or marked or marks.ends(name, closing) >= 0:
            flush()
        elif name == "br":
            put("\n")
        if leave_out:
            skip, depth = name, 1
            continue
        if name not in _VOID:
            marks.step(name, closing, marked)
        if not closing and not marked and name in ("main", "article", "h1") and marks.around:
            marks.all[marks.inner].wraps = True
        if name in ("article", "main"):
            articles = max(0, articles + (-1 if closing else 1))
        elif name == "a":
            link = 0 if closing else 1
        elif re.fullmatch("h[1-6]", name):
            heading = not closing
    flush()
    gone = marks.gone(lines)
    return [x for x in lines if x.mark < 0 or not gone[x.mark]]


def _raw_end(html: str, name: str, at: int) -> int:
    """Behind the end tag of an element whose content isn't markup; a missing one ends the page."""
    m = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, at)
    return m.end() if m else len(html)


def densest(weight: list[float], window: int) -> float:
    """The greatest sum of ``window`` lines next to each other, or of all if there are fewer."""
    now = most = sum(weight[:window])
    for k in range(window, len(weight)):
        now += weight[k] - weight[k - window]
        most = max(most, now)
    return most


def ends(lines: list[Line], window: int, surge: float) -> tuple[int, int]:
    """First line of the article and the one behind its last; (0, 0) if there is none.

    A line starts it if it and the ``window`` - 1 lines after it weigh the surge together; it ends with the last line for which that holds of it and the
    lines before. Lines weigh their characters outside links. The surge is ``surge`` characters, on a page of little text a quarter of its densest
    window. What a page marks as its article weighs a bonus more a line, which makes nine tenths of a surge by itself: it decides where text is thin, and nothing without text.
    """
    text = [x.weight for x in lines]
    least = min(surge, densest(text, window) / 4)
    if least <= 0:
        return 0, 0
    weight = [w + (0.9 * least / window if x.inside else 0) for w, x in zip(text, lines, strict=True)]
    n, sums = len(lines), [0.0]
    for w in weight:
        sums.append(sums[-1] + w)
    first = next(i for i in range(n) if weight[i] and sums[min(n, i + window)] - sums[i] >= least)
    last = next(i for i in range(n - 1, -1, -1) if weight[i] and sums[i + 1] - sums[max(0, i + 1 - window)] >= least)
    return first, max(first, last) + 1


def main_text(html: str | None, window: int = 3, surge: int = 60) -> str:
    """The article's blocks, joined by an empty line; empty if the page has none.

    The lines between surge and dive (see ``ends``), whatever they weigh, and the headings right before them.
    """
    lines = lines_of(html or "")
    first, end = ends(lines, window, surge)
    while end and first and lines[first - 1].heading:
        first -= 1
    return "\n\n".join(x.text for x in lines[first:end])


def extract(pages: DataFrame, column: str = "text") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html; others are ignored, whatever their names).

    Null and empty html have an empty text; null ids and urls stay. Rows are independent, so repeated rows have the same text each and an empty
    table gives an empty result. A very long page is worked through tag by tag, in time that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", column, "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id long, url string, {column} string, n_chars long")
