from __future__ import annotations

import datetime as dt
import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from panelloom.operators import complexity, pit
from panelloom.sources import archives, html_tables
from panelloom.streaming.ingest import ingest_available


def test_an_archive_of_many_members_is_read_in_many_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(50):
            z.writestr(f"dir/{k:02}.tsv", "".join(f"{k}\t{i}\r\n" for i in range(k)) + "last")
        z.writestr("dir/", "")
        z.writestr("odd.txt", b"\xff\xfe\n\n")
    (tmp_path / "none").mkdir()
    found = archives.members(spark, str(tmp_path / "*.zip"))
    assert found.count() == 51 and {r["bytes"] for r in found.where("member = 'odd.txt'").collect()} == {4}
    out = archives.lines(found)
    assert out.select("member", F.spark_partition_id().alias("p")).distinct().groupBy().agg(F.count_distinct("p")).first()[0] > 1
    got = {(r["member"], r["line"]): r["text"] for r in out.collect()}
    assert len(got) == sum(range(50)) + 50 + 2
    assert got["dir/07.tsv", 6] == "7\t6" and got["dir/07.tsv", 7] == "last" and got["odd.txt", 0] == "��" and got["odd.txt", 1] == ""


def book(path, sheets, shared):
    """A workbook as spreadsheets write it: shared strings with runs, several sheets, cells without a place."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="/xl/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join("<si>" + "".join(f"<r><t>{t}</t></r>" for t in parts) + "</si>" for parts in shared) + "</sst>")
        for k, (_, xml) in enumerate(sheets):
            z.writestr(f"xl/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{xml}</sheetData></worksheet>')


def test_workbook_cells(spark, tmp_path):
    first = '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>3.5</v></c><c r="AC2"/></row><row><c t="inlineStr"><is><t>x &amp; y</t></is></c><c t="b"><v>1</v></c></row>'
    book(tmp_path / "a.xlsx", [("One", first), ("Two", ""), ("Three", '<row r="1"><c r="B1" t="str"><v>z</v></c></row>')], [["no"], ["Use ", "table"]])
    book(tmp_path / "b.xlsx", [("One", "")], [])
    got = archives.workbooks(spark, str(tmp_path / "*.xlsx"))
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r["sheet"], r["row"], r["col"], r["text"]) for r in got.collect()) == [("One", 1, 0, "Use table"), ("One", 1, 27, "3.5"), ("One", 2, 0, "x & y"), ("One", 2, 1, "1"), ("Three", 0, 1, "z")]


def test_workbooks_written_are_read_back(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"{f}.xlsx", s, r, c, rng.choice(["a < b", "-1.25", "7", "é\"'", "007x"])) for f in "ab" for s in ("S & 1", "T") for r in range(6) for c in (0, 3, 26, 700)]
    cells = spark.createDataFrame(rows, "file string, sheet string, row long, col int, text string")
    assert len(archives.write_workbooks(cells, str(tmp_path / "out")).collect()) == 2
    got = archives.workbooks(spark, str(tmp_path / "out" / "*.xlsx")).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["sheet"], r["row"], r["col"], r["text"]) for r in got) == sorted(rows)


def test_flow_table_finds_its_header(spark):
    def row(r, *texts):
        return [("p", "s", r, c, t) for c, t in enumerate(texts) if t is not None]

    codes = [f"{k}00ABCDE" for k in range(101, 112)]
    rows = row(0, "Title", *["words"] * 12) + row(1, "12", "too few") + row(2, "Code", "Name", *codes) + row(3, "111CA0X", "n", "1,234.5", "x", "-2", None, "0") + row(4, "T05", "total", "9") + row(5, "1.1B", "short", "3")
    got = archives.flow_table(spark.createDataFrame(rows, "path string, sheet string, row long, col int, text string")).collect()
    assert sorted((r["source"], r["target"], r["flow"]) for r in got) == [("1.1B", "10100A", 3.0), ("111CA0", "10100A", 1234.5), ("111CA0", "10300A", -2.0), ("111CA0", "10500A", 0.0)]
    assert archives.flow_table(spark.createDataFrame([], "path string, sheet string, row long, col int, text string")).collect() == []


def grid(html):
    p = html_tables._Tables()
    p.feed(html)
    out = {}
    for t, r, c, _, text in p.finish():
        out.setdefault(t, {})[r, c] = text
    return out


def test_spans_and_tables_in_tables():
    a = grid("<table><tr><th rowspan=2>A<th colspan=2>B</tr><tr><td>1<td>2</tr><tr><td>x<td rowspan=9>y<table><tr><td>in</table>z<td>w<tr><td>last</table>")
    assert a[0] == {(0, 0): "A", (0, 1): "B", (0, 2): "B", (1, 0): "A", (1, 1): "1", (1, 2): "2", (2, 0): "x", (2, 1): "yz", (2, 2): "w", (3, 0): "last", (3, 1): "yz"} and a[1] == {(0, 0): "in"}
    assert grid("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>")[0] == {(0, 0): "a", (0, 1): "a", (0, 2): "b", (1, 0): "a", (1, 1): "a", (1, 2): "c"}
    assert grid("<table><td colspan=0>a<td colspan=-1>b<td rowspan=x>&lt;c&gt;<sup>[1]</sup><br>d <script>no</script></table>")[0] == {(0, 0): "a", (0, 1): "b", (0, 2): "<c> d"}
    assert grid("<p>no</p>") == grid("<table>") == grid("</td></tr></table>") == {}


def test_html_tables_in_sql(spark):
    html_tables.register(spark)
    rows = spark.sql("SELECT k, t.* FROM VALUES (1, '<table><tr><td>a<td>b</table>'), (2, CAST(NULL AS STRING)), (3, '') AS p(k, html), LATERAL html_tables(html) t").collect()
    assert sorted((r["k"], r["col"], r["text"]) for r in rows) == [(1, 0, "a"), (1, 1, "b")]


def test_constituents_by_synonym(spark):
    body = "".join(f"<tr><td>T{k}</td><td>N{k}</td><td>other</td></tr>" for k in range(3))
    pages = [("a", f"<table><tr><th>X<th>Y</tr>{body}</table><table><tr><th>EPIC</th><th>Company Name</th><th>Ticker</th></tr>{body}<tr><td></td><td>empty</td></tr></table>"), ("b", "<table><tr><th>Name<tr><td>x</table>")]
    found = html_tables.constituents(html_tables.cells(spark.createDataFrame(pages, "page string, html string"), "page"), "page", least_rows=3)
    assert sorted((r["page"], r["table"], r["row"], r["ticker"], r["name"], r["sector"]) for r in found.collect()) == [("a", 1, k + 1, f"T{k}", f"N{k}", None) for k in range(3)]


def test_ingestion_that_is_cut_off_goes_on(spark, tmp_path, monkeypatch):
    """A run that fails in its second batch, and one that goes on behind it, leave what one run leaves."""
    schema = "actor_id string, signal_id string, event_date timestamp_ntz, pub_date timestamp_ntz, value double, source string"
    rows = [(f"a{k % 7}", "s", dt.datetime(2020, 1, 1 + k % 9), dt.datetime(2020 + k % 3, 2, 1), float(k), "x") for k in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole, cut = pit.PointInTimeStore(spark, str(tmp_path / "whole")), pit.PointInTimeStore(spark, str(tmp_path / "cut"))
    ingest_available(stream(), whole, str(tmp_path / "c1"))
    done, ingest = [], pit.PointInTimeStore.ingest

    def failing(self, obs):
        ingest(self, obs)
        done.append(1)
        if len(done) == 2:
            raise RuntimeError("cut off behind its write")

    monkeypatch.setattr(pit.PointInTimeStore, "ingest", failing)
    with pytest.raises(Exception, match="cut off"):
        ingest_available(stream(), cut, str(tmp_path / "c2"))
    ingest_available(stream(), cut, str(tmp_path / "c2"))
    assert len(done) == 7  # the second batch came twice
    held = lambda s: sorted(map(str, s.table().select("actor_id", "event_date", "pub_date").collect()))
    assert held(cut) == held(whole) and len(held(cut)) == len({(r[0], r[2], r[3]) for r in rows})


def test_union_of_calendars_of_keys(spark):
    d = lambda n: dt.date(2020, 1, n)
    obs = spark.createDataFrame([("a", d(2), 1.0), ("a", d(2), 3.0), ("a", d(6), None), ("b", d(5), 9.0)], "k string, t date, value double")
    own = spark.createDataFrame([("a", d(1)), ("a", d(2)), ("a", d(9)), ("c", d(3))], "k string, t date")
    got = sorted((r["k"], r["t"].day, r["value"], r["observed"], r["asked"]) for r in pit.on_union_of_calendars(obs, own, ["k"]).collect())
    assert got == [("a", 1, None, False, True), ("a", 2, 3.0, True, True), ("a", 6, 3.0, True, False), ("a", 9, 3.0, False, True), ("b", 5, 9.0, True, False), ("c", 3, None, False, True)]


def test_compression_distance(spark):
    rng = random.Random(3)
    values = {(q, a): rng.random() for q in range(6) for a in range(80)}
    panel = spark.createDataFrame([("g", q, a, v) for (q, a), v in values.items()] + [("g", 2, 99, None)], "g string, q int, actor int, value double")
    codes = []
    for q in range(6):
        x = sorted(values[q, a] for a in range(80))
        cut = lambda p, x=x: x[int(79 * p)] + (79 * p - int(79 * p)) * (x[int(79 * p) + 1] - x[int(79 * p)])
        low, high = cut(0.333), cut(0.667)
        codes.append(bytes((values[q, a] > low) + (values[q, a] > high) for a in range(80)))
    size = lambda z: len(gzip.compress(z, compresslevel=9))
    want = [None] + [(size(x + y) - min(size(x), size(y))) / max(size(x), size(y)) for x, y in zip(codes, codes[1:])]
    found = complexity.successive_distances(panel, ["g"], "q")
    assert [r["ncd"] for r in found.orderBy("q").collect()] == [None] + [pytest.approx(w) for w in want[1:]]
    gate = [r["open"] for r in complexity.gate(found, ["g"], "q").orderBy("q").collect()]
    median = lambda z: sorted(z)[len(z) // 2] if len(z) % 2 else sum(sorted(z)[len(z) // 2 - 1 : len(z) // 2 + 1]) / 2
    assert gate == [True, True, True] + [want[k - 1] < median(want[1 : k - 1]) for k in range(3, 6)]
