"""Queries of payload parsers and mappers: tables are packed as the sources write them, then parsed back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import semantics as S
from panelloom.operators import normalise as N
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import _PCT, rounded
from panelloom.plans.standins import sql
from panelloom.sources import payloads as P
from panelloom.streaming import jobs

BOOK = Book()
page = BOOK.page


def _day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """(key, year, tag, period, value): a supplier's quantities by quarter and return flag. A payload holds one supplier's year."""
    period = S.quarter(F.col("l_shipdate"))
    li = st.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("tag"), period.alias("period")).agg(F.sum("l_quantity").alias("value"))


_QUARTERS = "SELECT l_suppkey AS key, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS tag, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS event_date, CAST(quarter(l_shipdate) AS INTEGER) AS q, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def _map(key, value) -> F.Column:
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


# --- filings and statements ---------------------------------------------------------------------------------------------


def _filings(spark: SparkSession, d: str) -> DataFrame:
    last = F.quarter("period") == 4
    form = F.when(last & (F.col("tag") == "N"), "8-K").when(last, "10-K").otherwise("10-Q")
    obs = F.struct(_day("period").alias("end"), _day(F.date_add("period", 45)).alias("filed"), F.col("value").alias("val"), form.alias("form"), F.concat(F.lit("Q"), F.quarter("period")).alias("fp"), F.col("year").alias("fy"))
    tags = _quarters(spark, d).groupBy("key", "year", "tag").agg(F.collect_list(obs).alias("rows"))
    body = _map(F.col("tag"), F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units")))
    return tags.groupBy("key", "year").agg(body.alias("tags")).select("key", "year", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.col("tags")).alias("facts"))).alias("payload"))


_FILED = "SELECT key, year, tag, 'USD' AS unit, event_date, CAST(event_date + 45 AS DATE) AS pub_date, round(value, 4) AS value, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form_type, year || 'Q' || q AS period FROM quarters WHERE tag <> 'N' OR q < 4"


@page(sql(_FILED, quarters=_QUARTERS), dates="event_date pub_date")
def company_facts_parsed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.company_facts(_filings(spark, d), ["key", "year"]), "value", digits=4)


@page(sql("SELECT * EXCLUDE (place) FROM (SELECT *, CASE tag WHEN 'R' THEN 1 ELSE 2 END AS place FROM filed WHERE tag IN ('R', 'A')) QUALIFY place = min(place) OVER (PARTITION BY key, year)", quarters=_QUARTERS, filed=_FILED), dates="event_date pub_date")
def first_tag_of_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = P.company_facts(_filings(spark, d), ["key", "year"], tags=["A", "R"])
    return rounded(P.first_tag(facts, ["key", "year"], ["R", "A"]), "value", digits=4)


@page(sql(
    "SELECT key, year, 'BS' AS statement, date, CAST(date + 60 AS VARCHAR) AS filing_date, 'EUR' AS currency, assets AS total_assets, CASE WHEN q <> 2 THEN assets / 2 END AS cash, NULL::DOUBLE AS capex FROM s UNION ALL SELECT key, year, 'CF', date, NULL, NULL, NULL, NULL, -assets FROM s",
    quarters=_QUARTERS, s="SELECT key, year, event_date AS date, q, round(sum(value), 4) AS assets FROM quarters GROUP BY ALL",
), dates="date")
def statements_parsed(spark: SparkSession, d: str) -> DataFrame:
    s = _quarters(spark, d).groupBy("key", "year", "period").agg(F.round(F.sum("value"), 4).alias("assets"))
    text = lambda c: c.cast("string")
    sheet = F.create_map(
        F.lit("filing_date"), _day(F.date_add("period", 60)), F.lit("currency_symbol"), F.lit("EUR"), F.lit("total_assets"), text(F.col("assets")),
        F.lit("cash"), F.when(F.quarter("period") != 2, text(F.col("assets") / 2)).otherwise("None"),
    )
    both = s.groupBy("key", "year").agg(_map(_day("period"), sheet).alias("bs"), _map(_day("period"), F.create_map(F.lit("capex"), text(-F.col("assets")))).alias("cf"))
    part = lambda c: F.struct(F.col(c).alias("quarterly"))
    raw = both.select("key", "year", F.to_json(F.struct(F.struct(part("bs").alias("Balance_Sheet"), part("cf").alias("Cash_Flow")).alias("Financials"))).alias("payload"))
    return P.statements(raw, ["key", "year"], ["total_assets", "cash", "capex"])


# --- macro series -------------------------------------------------------------------------------------------------------


@page(sql("SELECT o_custkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS event_date, CAST(o_orderdate AS DATE) + 30 AS pub_date, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 0"), dates="event_date pub_date")
def observations_parsed(spark: SparkSession, d: str) -> DataFrame:
    """A customer's year of orders as dated observations; '.' stands for a missing value."""
    day = F.col("o_orderdate").cast("date")
    o = F.struct(_day(day).alias("date"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise(".").alias("value"), _day(F.date_add(day, 30)).alias("realtime_start"))
    raw = st.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year")).agg(F.to_json(F.struct(F.collect_list(o).alias("observations"))).alias("payload"))
    return P.observations(raw, ["key", "year"])


_TOTALS = "SELECT c_mktsegment AS source, o_orderpriority AS target, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS flow FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def _totals(spark: SparkSession, d: str) -> DataFrame:
    x = st.table(spark, d, "orders").join(st.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("target"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("flow"))


@page(sql("SELECT source, target, year, flow FROM totals WHERE source <> 'BUILDING' OR year <> 1997", totals=_TOTALS))
def io_table_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Yearly tables with thousands commas and '---' for what is withheld."""
    hidden = (F.col("source") == "BUILDING") & (F.col("year") == 1997)
    row = F.struct(F.col("source").alias("RowCode"), F.col("target").alias("ColCode"), F.col("year").cast("string").alias("Year"), F.when(hidden, "---").otherwise(F.format_number("flow", 2)).alias("DataValue"))
    raw = _totals(spark, d).groupBy("year").agg(F.collect_list(row).alias("rows"))
    body = F.struct(F.struct(F.array(F.struct(F.col("rows").alias("Data"))).alias("Results")).alias("BEAAPI"))
    return P.table_rows(raw.select(F.to_json(body).alias("payload")), [])


@page(sql("SELECT source AS indicator, target AS country, year, flow AS value FROM totals", totals=_TOTALS))
def nested_years_parsed(spark: SparkSession, d: str) -> DataFrame:
    years = _totals(spark, d).groupBy("source", "target").agg(_map(F.col("year").cast("string"), F.col("flow")).alias("years"))
    raw = years.groupBy("source").agg(_map(F.col("target"), F.col("years")).alias("countries"))
    return P.nested_years(raw.select(F.to_json(F.struct(F.create_map("source", "countries").alias("values"))).alias("payload")), [])


@page(sql("SELECT key, CAST(year(event_date) AS VARCHAR) || '-Q' || q AS period, round(sum(value), 4) AS value FROM quarters WHERE q <> 3 GROUP BY ALL", quarters=_QUARTERS))
def sdmx_csv_parsed(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's year as CSV, columns in one order for even and another for odd keys; titles with commas and quotes, a quarter without a number."""
    q = _quarters(spark, d).groupBy("key", "year", F.quarter("period").alias("q")).agg(F.sum("value").alias("value"))
    time, value = F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("q").cast("string")), F.when(F.col("q") == 3, "n/a").otherwise(F.col("value").cast("string"))
    title, even = F.lit('"Sales, ""gross"", all"'), F.col("key") % 2 == 0
    line = F.when(even, F.concat_ws(",", F.lit("K"), title, time, value)).otherwise(F.concat_ws(",", value, F.lit("K"), time, title))
    head = F.when(even, 'KEY,TITLE,TIME_PERIOD,OBS_VALUE').otherwise('OBS_VALUE,KEY,"TIME_PERIOD",TITLE')
    raw = q.select("key", "year", head.alias("head"), line.alias("line")).groupBy("key", "year", "head").agg(F.collect_list("line").alias("lines"))
    return rounded(P.sdmx_csv(raw.select("key", F.concat("head", F.lit("\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\n")).alias("payload")), ["key"]), "value", digits=4)


@page(sql("SELECT key, 'A' || key AS area, tag AS indicator, CAST(year(event_date) AS VARCHAR) || '-Q' || q AS period, round(value, 4) AS value FROM quarters", quarters=_QUARTERS))
def sdmx_compact_parsed(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's year as compact SDMX: a series or an observation that is alone comes as an object, several as a list."""
    q = _quarters(spark, d).withColumn("p", F.concat(F.col("year").cast("string"), F.lit("-Q"), F.quarter("period").cast("string")))
    one = F.to_json(F.struct(F.col("p").alias("@TIME_PERIOD"), F.col("value").cast("string").alias("@OBS_VALUE")))
    alone = lambda c: F.when(F.size(c) == 1, F.get(c, 0)).otherwise(F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")))
    series = q.groupBy("key", "year", "tag").agg(F.collect_list(one).alias("o")).withColumn("o", alone("o"))
    text = F.format_string('{"@REF_AREA":"A%d","@INDICATOR":"%s","Obs":%s}', "key", "tag", "o")
    sets = series.groupBy("key", "year").agg(F.collect_list(text).alias("s")).withColumn("s", alone("s"))
    return rounded(P.sdmx_compact(sets.select("key", F.concat(F.lit('{"CompactData":{"DataSet":{"Series":'), "s", F.lit("}}}")).alias("payload")), ["key"]), "value", digits=4)


@page(sql("SELECT key, tag AS area, event_date AS period, round(value, 4) AS value FROM quarters WHERE tag <> 'N'", quarters=_QUARTERS), dates="period")
def sdmx_parsed(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's year as SDMX: series and observations named by their places in the dimensions' lists."""
    flags = ["A", "N", "R"]
    at = F.array_position(F.array(*map(F.lit, flags)), F.col("tag")) - 1
    series = _quarters(spark, d).groupBy("key", "year", "tag").agg(_map((F.quarter("period") - 1).cast("string"), F.array("value")).alias("observations"))
    sets = series.groupBy("key", "year").agg(_map(F.concat(at.cast("string"), F.lit(":0")), F.struct("observations")).alias("series"))
    dim = lambda name, values: F.struct(F.lit(name).alias("id"), F.array(*(F.struct(v.alias("id")) for v in values)).alias("values"))
    times = [F.concat(F.col("year").cast("string"), F.lit(f"-Q{q}")) for q in range(1, 5)]
    dims = F.struct(F.array(dim("AREA", map(F.lit, flags)), dim("FREQ", [F.lit("Q")])).alias("series"), F.array(dim("T", times)).alias("observation"))
    data = F.struct(F.array(F.struct(dims.alias("dimensions"))).alias("structures"), F.array(F.struct("series")).alias("dataSets"))
    found = P.sdmx_series(sets.select("key", F.to_json(F.struct(data.alias("data"))).alias("payload")), ["key"], {"AREA": ["A", "R"], "ABSENT": ["x"]})
    return rounded(found.select("key", F.col("dims")["AREA"].alias("area"), P.period_start(F.col("period")).alias("period"), "value"), "value", digits=4)


@page(sql("SELECT CAST(o_orderdate AS DATE) AS event_date, count(*) AS n, round(sum(round(o_totalprice, 2)), 2) AS total FROM orders GROUP BY 1"), dates="event_date")
def day_first_parsed(spark: SparkSession, d: str) -> DataFrame:
    lines = st.table(spark, d, "orders").select(F.date_format("o_orderdate", "dd MMM yyyy").alias("day"), F.format_number("o_totalprice", 2).alias("price"))
    return rounded(P.day_first(lines, "day", "price").groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=2)


# --- news, prices, slots ------------------------------------------------------------------------------------------------


@page(sql("SELECT DISTINCT ON (doc_id) CAST(doc_id AS VARCHAR) AS doc_id, lower(source) || '|war' AS themes, lower(lang) AS orgs, n_chars + 0.5::DOUBLE AS tone FROM documents WHERE doc_id IS NOT NULL"))
def news_lines_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated news lines with repeated themes."""
    x, source = F.lit("x"), F.upper("source")
    themes = F.concat(source, F.lit(",12;War,3;"), source, F.lit(",40;"))
    tone = F.concat(F.col("n_chars").cast("string"), F.lit(".5,2,3"))
    line = F.concat_ws("\t", x, x, x, x, F.col("doc_id").cast("string"), x, x, x, themes, x, x, x, x, x, F.concat("lang", F.lit(",5;")), tone)
    found = P.knowledge_graph(st.table(spark, d, "documents").where("doc_id is not null").select(line.alias("value")))
    return found.select("doc_id", F.array_join("themes", "|").alias("themes"), F.array_join("orgs", "|").alias("orgs"), "tone")


@page(sql("SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, l_returnflag AS ticker, round(avg(l_extendedprice), 4) AS close FROM lineitem GROUP BY 1, 2"), dates="date")
def long_prices_parsed(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem")
    wide = li.groupBy(S.quarter(F.col("l_shipdate")).alias("date")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_extendedprice"))
    return rounded(P.long_prices(wide), "close", digits=4)


@page(sql("SELECT day, minute FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute FROM events) QUALIFY row_number() OVER (PARTITION BY day ORDER BY abs(minute - 720), minute) = 1"), dates="day")
def nearest_slots(spark: SparkSession, d: str) -> DataFrame:
    slots = st.table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute")).distinct()
    return P.nearest_slot(slots, "day", "minute")


@page(sql("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"), dates="week_start")
def weekly_tone_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming job's plan on the whole table at once."""
    return rounded(jobs.weekly_tone(st.table(spark, d, "events")), "total", digits=4)


# --- mappers ------------------------------------------------------------------------------------------------------------

_KINDS = {0: "bank", 1: "central_bank", 2: "unknown"}


@page(sql(
    "SELECT actor, period, layer, round(CASE layer WHEN 0 THEN r WHEN 1 THEN m END, 6) AS intensity FROM mapped JOIN registry USING (actor)", "gappy", "registry",
    mapped=f"SELECT actor, period, {_PCT} AS r, CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER (PARTITION BY period) > min(value) OVER (PARTITION BY period) THEN (value - min(value) OVER (PARTITION BY period)) / (max(value) OVER (PARTITION BY period) - min(value) OVER (PARTITION BY period)) ELSE 0.5 END AS m FROM gappy",
), dates="period")
def mapped_intensities(spark: SparkSession, d: str) -> DataFrame:
    """Every actor's intensity by its type's mapper; a type that no mapper is registered for has none."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), F.col("layer"))
    typed = st.gappy(spark, d).join(st.registry(spark, d).select("actor", "layer"), "actor").withColumn("actor_type", kind)
    return rounded(N.MapperRegistry().mapped(typed).select("actor", "period", "layer", "intensity"), "intensity")
