"""ZIP archives by member, and workbooks (XLSX) as tables of cells.

Both are read by ranges: an archive's directory first, then each member where a task needs it.
"""

from __future__ import annotations

import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BATCH = 10_000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that the path's scheme names, and the place in it; a path as Spark gives it isn't escaped."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place."""
    store, place = _located(path)
    return store.open_input_file(place)


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of files by glob or folder; contents aren't loaded."""
    return spark.read.format("binaryFile").load(path).select("path")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, bytes): the files in ZIP archives, from the archives' directories alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column("path").to_pylist():
                with _opened(where) as raw, zipfile.ZipFile(raw) as archive:
                    rows = [(where, m.filename, m.file_size) for m in archive.infolist() if not m.is_dir()]
                for k in range(0, len(rows), _BATCH):
                    part = list(zip(*rows[k : k + _BATCH], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64())], names=["path", "member", "bytes"])

    return _paths(spark, path).mapInArrow(run, "path string, member string, bytes long")


def lines(found: DataFrame, encoding: str = "utf-8", parts: int | None = None) -> DataFrame:
    """(path, member, line, text) of ``members``: each is read by a task of its own, or with others in one of ``parts``, line by line.

    Only the member's own range is fetched and unpacked. Bytes that aren't in the encoding become replacement characters; lines end with \\n or \\r\\n.
    """
    spark = found.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, member in zip(batch.column("path").to_pylist(), batch.column("member").to_pylist(), strict=True):
                with _opened(where) as raw, zipfile.ZipFile(raw) as archive, archive.open(member) as content:
                    text: list[str] = []
                    first = 0
                    for line in io.TextIOWrapper(content, encoding=encoding, errors="replace", newline="\n"):
                        text.append(line.removesuffix("\n").removesuffix("\r"))
                        if len(text) == _BATCH:
                            yield _numbered(where, member, first, text)
                            first, text = first + len(text), []
                    if text:
                        yield _numbered(where, member, first, text)

    return found.select("path", "member").repartition(n).mapInArrow(run, "path string, member string, line long, text string")


def _numbered(path: str, member: str, first: int, text: list[str]) -> pa.RecordBatch:
    n = len(text)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([member] * n), pa.array(range(first, first + n), pa.int64()), pa.array(text, pa.string())], names=["path", "member", "line", "text"])


# --- workbooks -------------------------------------------------------------------------------------------------------

#: The format's namespaces.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    """Number of a cell's column from 0: A, B, ... Z, AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def sheet_rows(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text), both from 0, of all cells with a value, sheets in their order; a sheet is parsed row by row."""
    names = set(archive.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        with archive.open("xl/sharedStrings.xml") as raw:
            for _, e in ElementTree.iterparse(raw):
                if e.tag == f"{_MAIN}si":
                    shared.append(_texts(e))
                    e.clear()
    targets = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        with archive.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as raw:
            row = -1
            for _, e in ElementTree.iterparse(raw):
                if e.tag != f"{_MAIN}row":
                    continue
                row, column = int(e.get("r") or row + 2) - 1, -1
                for c in e.iter(f"{_MAIN}c"):
                    column = _column(c.get("r")) if c.get("r") else column + 1
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    text = _texts(c) if kind == "inlineStr" else None if value is None or value.text is None else shared[int(value.text)] if kind == "s" else value.text
                    if text:
                        yield sheet.get("name") or "", row, column, text
                e.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Workbooks(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            rows: list[tuple] = []
            for cell in sheet_rows(archive):
                rows.append(cell)
                if len(rows) == _BATCH:
                    yield self._batch(partition.path, rows)
                    rows = []
            if rows:
                yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
        sheet, row, column, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(sheet, pa.string()), pa.array(row, pa.int64()), pa.array(column, pa.int32()), pa.array(text, pa.string())], names=["path", "sheet", "row", "col", "text"])


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("paths", "a.xlsx\\nb.xlsx").load()``: (path, sheet, row, col, text), a workbook a partition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, row long, col int, text string"

    def reader(self, schema) -> DataSourceReader:
        given = self.options.get("paths") or self.options.get("path") or ""
        return _Workbooks([p for p in given.split("\n") if p])


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks of a folder or glob."""
    spark.dataSource.register(WorkbookSource)
    files = sorted(r["path"] for r in _paths(spark, path).collect())  # names of workbooks
    if not files:
        return spark.createDataFrame([], "path string, sheet string, row long, col int, text string")
    return spark.read.format("workbook").option("paths", "\n".join(files)).load()


def _code(text) -> F.Column:
    """Does it begin with three digits, or fewer and a dot?"""
    return F.regexp_like(F.replace(F.substring(F.trim(text), 1, 3), F.lit("."), F.lit("")), F.lit("^[0-9]+$"))


def flow_table(cells: DataFrame, least: int = 10) -> DataFrame:
    """(path, sheet, source, target, flow) of sheets that hold a table of flows.

    The header is a sheet's first row with more than ``least`` cells of which one from the third to the tenth begins with digits; its codes name the columns, those
    in column 0 the rows below. Codes are cut to six characters; cells that aren't numbers are left out, thousands' commas are not.
    """
    sheet = ["path", "sheet"]
    place = F.row_number().over(Window.partitionBy(*sheet, "row").orderBy("col"))
    heads = cells.withColumn("k__", place).groupBy(*sheet, "row").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("k__").between(3, 10) & F.regexp_like(F.substring(F.trim("text"), 1, 3), F.lit("^[0-9]+$"))).alias("coded"))
    first = heads.where((F.col("n") > least) & F.col("coded")).groupBy(*sheet).agg(F.min("row").alias("head__"))
    below = cells.join(first, sheet)
    name = F.substring(F.trim("text"), 1, 6)
    targets = below.where((F.col("row") == F.col("head__")) & _code(F.col("text"))).select(*sheet, "col", name.alias("target"))
    sources = below.where((F.col("row") > F.col("head__")) & (F.col("col") == 0) & _code(F.col("text"))).select(*sheet, "row", name.alias("source"))
    flow = F.replace(F.col("text"), F.lit(","), F.lit("")).try_cast("double")
    body = below.where(F.col("row") > F.col("head__")).join(targets, [*sheet, "col"]).join(sources, [*sheet, "row"])
    return body.select(*sheet, "source", "target", flow.alias("flow")).where("flow is not null")


# --- sinks -----------------------------------------------------------------------------------------------------------


def _created(folder: str, name: str):
    """(file system, draft, place) of a file to be: it is written under a draft name, so that a task that is run twice leaves one whole file."""
    store, base = _located(folder)
    store.create_dir(base, recursive=True)
    return store, f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"


def _files(rows: DataFrame, folder: str, write) -> DataFrame:
    """(path) of files named by ``rows``' column file; rows of a file come to ``write`` in order, a file a task."""
    fields = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (dict(zip(fields, r, strict=True)) for b in batches for r in zip(*(b.column(f).to_pylist() for f in fields), strict=True))
        for name, part in itertools.groupby(flat, key=lambda r: r["file"]):
            store, draft, place = _created(folder, name)
            with store.open_output_stream(draft) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
                write(archive, part)
            store.move(draft, place)
            yield pa.RecordBatch.from_arrays([pa.array([place])], names=["path"])

    order = [c for c in ("file", "member", "sheet", "row", "col", "line") if c in fields]
    return rows.repartition("file").sortWithinPartitions(*order).mapInArrow(run, "path string")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``rows`` (file, member, line, text) as ZIP archives when its result (path) is taken: a member's lines end with \\n."""

    def write(archive: zipfile.ZipFile, part: Iterator[dict]) -> None:
        for member, lines_ in itertools.groupby(part, key=lambda r: r["member"]):
            with archive.open(member, "w") as out:
                for r in lines_:
                    out.write(f"{r['text']}\n".encode())

    return _files(rows.select("file", "member", "line", "text"), folder, write)


def write_workbooks(cells: DataFrame, folder: str) -> DataFrame:
    """Writes ``cells`` (file, sheet, row, col, text) as workbooks when its result (path) is taken; numbers become numbers, rows are streamed."""

    def letters(col: int) -> str:
        out = ""
        while col >= 0:
            out, col = chr(65 + col % 26) + out, col // 26 - 1
        return out

    def write(archive: zipfile.ZipFile, part: Iterator[dict]) -> None:
        sheets = []
        for sheet, of_sheet in itertools.groupby(part, key=lambda r: r["sheet"]):
            sheets.append(sheet)
            with archive.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w") as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                for row, of_row in itertools.groupby(of_sheet, key=lambda r: r["row"]):
                    out.write(f'<row r="{row + 1}">'.encode())
                    for c in of_row:
                        number = re.fullmatch(r"-?\d+(\.\d+)?", c["text"])
                        value = f"<v>{c['text']}</v>" if number else f"<is><t>{escape(c['text'])}</t></is>"
                        out.write(f'<c r="{letters(c["col"])}{row + 1}"{"" if number else " t=" + chr(34) + "inlineStr" + chr(34)}>{value}</c>'.encode())
                    out.write(b"</row>")
                out.write(b"</sheetData></worksheet>")
        entries = "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{entries}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')

    return _files(cells.select("file", "sheet", "row", "col", "text"), folder, write)
