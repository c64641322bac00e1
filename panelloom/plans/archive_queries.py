"""Archives, workbooks, HTML tables, resumed ingestion and calendars: tables are packed as the sources come, read back and held against SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import autoregression as ar
from panelloom.operators import complexity, pit
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded
from panelloom.plans.standins import sql
from panelloom.session import shared_dir, written
from panelloom.sources import archives, html_tables
from panelloom.streaming import jobs
from panelloom.streaming.ingest import ingest_available

BOOK = Book()
page = BOOK.page


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- archives ----------------------------------------------------------------------------------------------------------


@page(sql("SELECT r_name || '.zip' AS file, replace(n_name, ' ', '_') || '/' || c_mktsegment || '.tsv' AS member, row_number() OVER (PARTITION BY n_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS line, c_custkey || chr(9) || c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def zip_members_read(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lines of an archive a region, a member a nation and segment."""
    c = st.table(spark, d, "customer").join(st.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(st.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select(
        F.concat("r_name", F.lit(".zip")).alias("file"), F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("/"), "c_mktsegment", F.lit(".tsv")).alias("member"),
        F.col("c_custkey").alias("line"), F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("text"),
    )
    folder = _folder(spark, "zips")
    archives.write_archives(rows, folder).collect()
    found = archives.lines(archives.members(spark, f"{folder}/*.zip"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "member", "line", "text")


_FLOWS = "SELECT CAST(year(o_orderdate) AS VARCHAR) || '.xlsx' AS file, CAST(100 + s_nationkey AS VARCHAR) || 'A0' AS source, CAST(200 + c_nationkey AS VARCHAR) || 'B0' AS target, round(sum(l_quantity), 2) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


@page(sql(_FLOWS))
def workbook_flows(spark: SparkSession, d: str) -> DataFrame:
    """Quantities from nation to nation as a workbook a year: a title, a header of codes below it, names beside the codes, notes at the end."""
    x = st.table(spark, d, "lineitem").join(st.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(st.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(st.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flows = x.groupBy(F.concat(F.year("o_orderdate").cast("string"), F.lit(".xlsx")).alias("file"), "s_nationkey", "c_nationkey").agg(F.round(F.sum("l_quantity"), 2).alias("flow"))
    flows = flows.select("*", F.lit("Use").alias("sheet"))
    cell = lambda row, col, text: F.struct(F.lit(row).cast("long").alias("row") if isinstance(row, int) else row.cast("long").alias("row"), (F.lit(col) if isinstance(col, int) else col).cast("int").alias("col"), text.alias("text"))
    s, c = F.col("s_nationkey"), F.col("c_nationkey")
    # Numbers of three digits and more are written with commas, as text.
    shown = F.when(F.col("flow") >= 1000, F.format_number("flow", 2)).otherwise(F.format_string("%.2f", "flow"))
    body = F.array(
        cell(s + 3, c + 2, shown), cell(s + 3, 0, F.concat((s + 100).cast("string"), F.lit("A0"))), cell(s + 3, 1, F.concat(F.lit("Nation "), s.cast("string"))), cell(2, c + 2, F.concat((c + 200).cast("string"), F.lit("B0"))),
        cell(0, 0, F.lit("Use of commodities, <millions> & more")), cell(2, 0, F.lit("Code")), cell(2, 1, F.lit("Name")), cell(40, 0, F.lit("Note")), cell(40, 2, F.lit("1")),
    )
    cells = flows.select("file", "sheet", F.inline(body)).distinct()
    folder = _folder(spark, "books")
    archives.write_workbooks(cells, folder).collect()
    found = archives.flow_table(archives.workbooks(spark, f"{folder}/*.xlsx"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "source", "target", "flow")


# --- HTML tables -------------------------------------------------------------------------------------------------------

#: A page holds at most so many of a nation's suppliers.
_ROWS = 40


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Lists of suppliers, a nation and ``_ROWS`` places a page: a small table before, the sector's cell over all rows, some names and symbols in one cell."""
    s = st.registry(spark, d).withColumn("part", F.floor(F.col("actor") / 1000))
    both = F.format_string('<td colspan="2">S%d</td>', "actor")
    cells = F.when(F.col("actor") % 10 == 0, both).otherwise(F.format_string("<td>S%d<sup>[1]</sup></td><td>%s &amp; Co</td>", "actor", "name"))
    rows = s.groupBy("geography", "sector", "part").agg(F.array_sort(F.collect_list(F.struct("actor", cells.alias("c")))).alias("r"))
    first = F.format_string("<tr>%s<td rowspan=%d>%s</td>", F.col("r")[0]["c"], F.size("r"), F.col("sector"))
    rest = F.array_join(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda x: F.concat(F.lit("<tr>"), x["c"])), "\n")
    html = F.concat(F.lit("<table><tr><th>Symbol<th>Note<tr><td>none<td>x</table><p>List</p><table><thead><tr><th>Symbol</th><th>Company</th><th>GICS Sector</th></tr></thead>"), first, F.lit("</tr>"), rest, F.lit("</table>"))
    return rows.select(F.concat_ws("/", "geography", F.col("part").cast("string")).alias("page"), html.alias("html"))


_LISTED = "SELECT geography || '/' || (actor // 1000) AS page, actor, sector, row_number() OVER (PARTITION BY geography, actor // 1000 ORDER BY actor) AS row, 'S' || actor AS ticker, CASE WHEN actor % 10 = 0 THEN 'S' || actor ELSE name || ' & Co' END AS name FROM registry"


@page(sql("SELECT page, 1 AS \"table\", CAST(row AS INTEGER) AS row, ticker, name, sector FROM l WHERE (page, 2) IN (SELECT page, 2 FROM l GROUP BY page HAVING count(*) >= 2)", "registry", l=_LISTED))
def html_constituents(spark: SparkSession, d: str) -> DataFrame:
    return html_tables.constituents(html_tables.cells(_pages(spark, d), "page"), "page", least_rows=2)


@page(sql("SELECT page, \"table\", count(*) AS n_cells, count(*) FILTER (header) AS n_headers, md5(string_agg(text, '|' ORDER BY row, col)) AS digest FROM (SELECT page, 1 AS \"table\", CAST(row AS INTEGER) AS row, unnest([0, 1, 2]) AS col, unnest([ticker, name, sector]) AS text, false AS header FROM l UNION ALL SELECT DISTINCT page, 1, 0, unnest([0, 1, 2]), unnest(['Symbol', 'Company', 'GICS Sector']), true FROM l UNION ALL SELECT DISTINCT page, 0, unnest([0, 0, 1, 1]), unnest([0, 1, 0, 1]), unnest(['Symbol', 'Note', 'none', 'x']), unnest([true, true, false, false]) FROM l) GROUP BY ALL", "registry", l=_LISTED))
def html_table_cells(spark: SparkSession, d: str) -> DataFrame:
    g = html_tables.cells(_pages(spark, d), "page").groupBy("page", "table")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda c: c["text"]), "|")
    return g.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("header").alias("n_headers"), F.md5(text).alias("digest"))


# --- resumed ingestion, calendars ------------------------------------------------------------------------------------------


@page(sql("SELECT actor_id, signal_id, CAST(event_date AS DATE) AS event_date, CAST(pub_date AS DATE) AS pub_date, source, round(max(value), 6) AS value FROM obs GROUP BY ALL", "obs"), dates="event_date pub_date")
def resumed_ingestion(spark: SparkSession, d: str) -> DataFrame:
    """Observations arrive in two halves, some of the first again with the second; the stream stops in between and goes on from its checkpoint."""
    rows = st.observations(spark, d).withColumn("half", F.pmod(F.xxhash64("actor_id", "event_date"), F.lit(3)))
    folder, store = _folder(spark, "arriving"), pit.PointInTimeStore(spark, _folder(spark, "pit"))
    plain = rows.drop("half")
    for wanted in ("half < 2", "half > 0"):
        # Within a file rows of one key and publication are one already; over files the later batch has the same.
        one = rows.where(wanted).groupBy(*[c for c in plain.columns if c != "value"]).agg(F.max("value").alias("value")).select(*plain.columns)
        one.repartition(3, "actor_id").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 2).parquet(folder)
        ingest_available(stream, store, f"{folder}-checkpoint")
    return rounded(store.table().select("actor_id", "signal_id", F.col("event_date").cast("date").alias("event_date"), F.col("pub_date").cast("date").alias("pub_date"), "source", "value"), "value")


def _streamed(spark: SparkSession, rows: DataFrame, time: str, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What ``job`` puts out of ``rows`` that arrive in three thirds of their time, those without one last, the stream ended and started anew in between."""
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    third = F.when(seconds.isNull() | (seconds == last), F.lit(2)).otherwise(F.floor(3 * (seconds - F.lit(first)) / F.lit(max((last or 0) - (first or 0), 1)))).cast("int")
    folder, out = _folder(spark, "arriving"), _folder(spark, "put")
    for k in range(3):
        rows.where(third == k).write.mode("append").parquet(folder)
        jobs.put_available(job(spark.readStream.schema(rows.schema).parquet(folder)), out, f"{folder}-checkpoint", mode)
    return spark.read.parquet(out)


@page(sql("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"), dates="week_start")
def streamed_tone_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weekly sums of a stream in update mode: a week that a restart cuts in two is put out twice, and the later row counts."""
    events = st.table(spark, d, "events").where("ts is not null").select("event_type", "ts", "value")
    put = _streamed(spark, events, "ts", jobs.weekly_tone, "update")
    return rounded(jobs.latest(put, ["event_type", "week_start"]), "total", digits=4)


_FILTERED = "(WITH RECURSIVE y AS (SELECT actor, value, row_number() OVER (PARTITION BY actor ORDER BY period) AS step FROM panel), k AS (SELECT DISTINCT actor, CAST(0 AS BIGINT) AS step, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS predicted, 0.0::DOUBLE AS a, 1.0::DOUBLE AS p, 0.5::DOUBLE AS q FROM y UNION ALL SELECT actor, step, value, a1, a1 + s, (1 - g) * (1 - g) * p1 + 0.1 * g * g, 0.7 * q + 0.3 * s * s + 1e-6 FROM (SELECT *, g * (value - a1) AS s FROM (SELECT *, p1 / (p1 + 0.1) AS g FROM (SELECT y.actor, y.step, y.value, 0.9 * k.a AS a1, 0.81 * k.p + k.q AS p1, k.q FROM k JOIN y ON y.actor = k.actor AND y.step = k.step + 1)))) SELECT * FROM k WHERE step > 0)"


@page(sql(f"SELECT actor, CAST(step AS INTEGER) AS step, round(value, 6) AS value, round(predicted, 6) AS predicted FROM {_FILTERED}", "panel"))
def streamed_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each actor's filter over a stream of quarters, its state taken along over two restarts."""
    with jobs.state_by_value(spark):
        put = _streamed(spark, written(st.panel(spark, d)), "period", jobs.online_filter, "append")
    return rounded(put.drop("batch"), "value", "predicted")


@page(sql(
    "SELECT actor, t, round(last_value(v IGNORE NULLS) OVER (PARTITION BY actor ORDER BY t), 6) AS value, o AS observed, c AS asked FROM (SELECT actor, t, max(v) AS v, bool_or(o) AS o, bool_or(c) AS c FROM (SELECT actor, period AS t, value AS v, true AS o, false AS c FROM gappy UNION ALL SELECT s_suppkey, CAST(t AS DATE), NULL, false, true FROM supplier, LATERAL (SELECT unnest(generate_series(DATE '1996-01-01' + CAST(20 * (s_suppkey % 4) AS INTEGER), DATE '1999-12-31', INTERVAL 2 MONTH)) AS t)) GROUP BY 1, 2)",
    "gappy",
), dates="t")
def union_of_calendars(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly values on the union of their quarters and each actor's own two-month calendar."""
    start = F.date_add(F.lit("1996-01-01").cast("date"), (20 * (F.col("s_suppkey") % 4)).cast("int"))
    own = st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("actor"), F.explode(F.sequence(start, F.lit("1999-12-31").cast("date"), F.expr("interval 2 months"))).alias("t"))
    obs = st.gappy(spark, d).select("actor", F.col("period").alias("t"), "value")
    return rounded(pit.on_union_of_calendars(obs, own, ["actor"]), "value")


# --- compression distance (no SQL: no engine at hand compresses) -------------------------------------------------------------


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = st.dealt(spark, d)
    slopes = ar.rho(rows, []).select("test_year", "rho")
    return ar.deviations(rows).join(slopes, "test_year").where("prev is not null").select("test_year", "period", "actor", "train", (F.col("dev") - F.col("rho") * F.col("prev")).alias("value"))


@page()
def compression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each test quarter's gate by the distance of the last two residual cross-sections known before it."""
    r = _residuals(spark, d)
    tests = r.where("not train").select("test_year", "period").distinct()
    distances = complexity.successive_distances(r, ["test_year"], "period")
    return rounded(complexity.gate(distances, ["test_year"], "period").join(tests, ["test_year", "period"]).join(distances, ["test_year", "period"]), "ncd")
