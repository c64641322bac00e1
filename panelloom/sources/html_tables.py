"""Tables of HTML pages as rows of cells, spans resolved: a table function for SQL, and constituent lists found by their headers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_CELLS = "table: int, row: int, col: int, header: boolean, text: string"
#: No span of a cell reaches further, whatever a page says.
_WIDEST = 1000


class _Table:
    def __init__(self, number: int):
        self.number, self.row, self.col = number, -1, 0
        self.cell: tuple[int, int, bool, list[str]] | None = None  # row span, column span, header, text
        self.over: dict[int, tuple[int, bool, str]] = {}  # column -> a cell from above that covers this row: rows left, what it is
        self.next: dict[int, tuple[int, bool, str]] = {}  # the same for the next row
        self.cells: list[tuple[int, int, int, bool, str]] = []

    def _put(self, rows: int, header: bool, text: str) -> None:
        self.cells.append((self.number, self.row, self.col, header, text))
        if rows > 1:
            self.next[self.col] = (rows - 1, header, text)
        self.col += 1

    def _carry(self) -> None:
        while self.col in self.over:
            self._put(*self.over.pop(self.col))

    def close_cell(self) -> None:
        if self.cell is not None:
            rows, columns, header, text = self.cell
            self.cell = None
            self._carry()
            for _ in range(columns):
                self._put(rows, header, " ".join("".join(text).split()))

    def close_row(self) -> None:
        self.close_cell()
        for self.col in sorted(self.over):
            self._put(*self.over.pop(self.col))

    def open_row(self) -> None:
        self.close_row()
        self.row, self.col = self.row + 1, 0
        self.over, self.next = self.next, {}

    def open_cell(self, header: bool, rows: int, columns: int) -> None:
        self.close_cell()
        if self.row < 0:
            self.open_row()
        self.cell = (rows, columns, header, [])


def _span(value: str | None) -> int:
    digits = (value or "").strip()
    return min(max(int(digits), 1), _WIDEST) if digits.isascii() and digits.isdigit() else 1


class _Tables(HTMLParser):
    """Tables in the order in which they open; one inside a cell is a table of its own, and its text isn't the cell's."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.seen = 0
        self.done: list[tuple[int, int, int, bool, str]] = []
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append(_Table(self.seen))
            self.seen += 1
        elif tag in ("script", "style", "sup"):
            self.quiet += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t.open_row()
            elif tag in ("td", "th"):
                a = dict(attrs)
                t.open_cell(tag == "th", _span(a.get("rowspan")), _span(a.get("colspan")))
            elif tag == "br" and t.cell is not None:
                t.cell[3].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "sup"):
            self.quiet = max(0, self.quiet - 1)
        elif self.open:
            t = self.open[-1]
            if tag == "table":
                t.close_row()
                self.done += self.open.pop().cells
            elif tag == "tr":
                t.close_row()
            elif tag in ("td", "th"):
                t.close_cell()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None and not self.quiet:
            self.open[-1].cell[3].append(data)

    def finish(self) -> list[tuple[int, int, int, bool, str]]:
        self.close()
        while self.open:
            self.handle_endtag("table")
        return sorted(self.done)


class HtmlTables:
    """``SELECT ... FROM pages, LATERAL html_tables(html)``: every cell of every table of a page.

    A cell that spans rows or columns comes once for each place it covers. Rows and columns count from 0; footnote marks (sup), scripts and
    styles aren't text. Tables and rows that aren't closed end with what is around them; null has no tables.
    """

    def eval(self, html: str) -> Iterator[tuple[int, int, int, bool, str]]:
        if html:
            parser = _Tables()
            parser.feed(html)
            yield from parser.finish()


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_tables", udtf(HtmlTables, returnType=_CELLS))


def cells(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """(keep..., table, row, col, header, text) of all ``pages``."""
    register(pages.sparkSession)
    names = ", ".join(f"p.`{k}`" for k in keep)
    return pages.sparkSession.sql(f"SELECT {names}{', ' if keep else ''}c.* FROM {{pages}} p, LATERAL html_tables(p.`{html}`) c", pages=pages)


#: What a list of constituents calls its columns.
SYNONYMS = {
    "ticker": ("symbol", "ticker", "epic", "tidm", "ticker_symbol", "code"),
    "name": ("company", "security", "name", "company_name"),
    "sector": ("gics_sector", "sector", "industry", "gics_economic_sector"),
}


def constituents(found: DataFrame, page: str, least_rows: int = 20, synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(page, table, row, *synonyms) of the first table of each page with ``least_rows`` rows and a column of the first name.

    Headers are the tables' first rows, in lower case with _ for spaces; of columns with the same meaning the first counts, and a meaning without
    a column is null. Rows without a value in the first column are left out.
    """
    synonyms = synonyms or SYNONYMS
    key = next(iter(synonyms))
    said = F.replace(F.replace(F.lower(F.trim("text")), F.lit(" "), F.lit("_")), F.lit("\xa0"), F.lit("_"))
    meaning = F.coalesce(*(F.when(said.isin(*words), F.lit(name)) for name, words in synonyms.items()))
    table = [page, "table"]
    heads = found.where("row = 0").withColumn("meaning", meaning).where("meaning is not null").groupBy(*table, "meaning").agg(F.min("col").alias("col"))
    sizes = found.where("row > 0").groupBy(*table).agg(F.count_distinct("row").alias("n")).where(F.col("n") >= least_rows)
    right = sizes.join(heads.where(F.col("meaning") == key).select(*table), table).groupBy(page).agg(F.min("table").alias("table"))
    body = found.where("row > 0").join(right, table, "left_semi").join(heads, [*table, "col"])
    rows = body.groupBy(*table, "row").agg(*(F.max(F.when(F.col("meaning") == name, F.col("text"))).alias(name) for name in synonyms))
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "")
