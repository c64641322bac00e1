"""Firm, macro and institutional intensities of statements and series, their registry, and what experiments still lack."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import european
from panelloom.operators import universe as U
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded
from panelloom.plans.standins import sql
from panelloom.session import shared_dir

BOOK = Book()
page = BOOK.page

_FIRST, _LAST = dt.date(1995, 1, 1), dt.date(2001, 10, 1)
_QUARTERS = "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTHS)) AS DATE) AS period"
#: Statements: shipments of return flag A are balance sheets, of R cash flows; each of a supplier and day.
_STATEMENTS = "SELECT 'S' || l_suppkey || '.X' || (l_suppkey % 3) AS actor, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'A' THEN round(sum(l_extendedprice), 2) END AS assets, CASE WHEN l_returnflag = 'R' THEN -round(sum(l_tax * l_extendedprice), 2) END AS capex FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_suppkey, 2, l_returnflag"


def _cents(x: Column) -> Column:
    """``x`` to two places by way of x * 100, as the SQL's engine rounds: Spark's own rounding takes the shortest decimal, and products of two-place numbers are often ties (268.775)."""
    return F.round(x * 100) / 100


def _statements(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem").where("l_returnflag <> 'N'")
    g = li.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_returnflag").agg(_cents(F.sum("l_extendedprice")).alias("total_assets"), (-_cents(F.sum(F.col("l_tax") * F.col("l_extendedprice")))).alias("capex"))
    return g.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.concat(F.lit("X"), (F.col("l_suppkey") % 3).cast("string")).alias("exchange"), F.when(F.col("l_returnflag") == "A", "BS").otherwise("CF").alias("statement"), "date", "total_assets", "capex")


_LAST_OF = "arg_max({0}, {{'d': date, 'v': {0}}}) FILTER ({0} IS NOT NULL)"


@page(sql(
    "SELECT actor, period, round((rank() OVER (PARTITION BY period ORDER BY ratio) + (count(*) OVER (PARTITION BY period, ratio) - 1) / 2) / count(*) OVER (PARTITION BY period), 6) AS intensity, 'capex_assets_xsrank' AS method FROM r WHERE ratio IS NOT NULL",
    s=_STATEMENTS, k=f"SELECT actor, CAST(date_trunc('quarter', date) AS DATE) AS period, {_LAST_OF.format('assets')} AS assets, {_LAST_OF.format('capex')} AS capex FROM s GROUP BY ALL", q=_QUARTERS,
    g="SELECT actor, period, coalesce(assets, lag(assets) OVER w) AS assets, coalesce(capex, lag(capex) OVER w) AS capex FROM (SELECT DISTINCT actor FROM s) CROSS JOIN q LEFT JOIN k USING (actor, period) WINDOW w AS (PARTITION BY actor ORDER BY period)",
    r="SELECT actor, period, CASE WHEN assets > 0 THEN least(abs(capex) / assets, 1) END AS ratio FROM g",
), dates="period")
def firm_spending_intensities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(european.firm_intensities(_statements(spark, d), _FIRST, _LAST), "intensity")


_SERIES = "SELECT 'N' || o_custkey % 12 AS source, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS value FROM orders WHERE o_custkey % 12 <> 5 GROUP BY ALL"
#: Actor n takes source N<n // 2>; every third is measured by its change.
_ACTORS = "SELECT CASE WHEN n % 4 = 0 THEN 'macro_' WHEN n % 4 = 1 THEN 'inst_ecb_' WHEN n % 4 = 2 THEN 'inst_boe_' ELSE 'inst_' END || n AS actor, 'N' || n // 2 AS source, CASE WHEN n % 3 = 0 THEN 'cumulative_change' ELSE 'level' END AS transform, CASE WHEN n % 4 = 0 THEN 0 ELSE 1 END AS layer FROM range(24) AS t(n)"


def _actors(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    head = F.when(n % 4 == 0, "macro_").when(n % 4 == 1, "inst_ecb_").when(n % 4 == 2, "inst_boe_").otherwise("inst_")
    return spark.range(24).select(
        F.concat(head, n.cast("string")).alias("actor"), F.concat(F.lit("N"), F.floor(n / 2).cast("string")).alias("source"),
        F.when(n % 3 == 0, "cumulative_change").otherwise("level").alias("transform"), F.when(n % 4 == 0, 0).otherwise(1).alias("layer"),
    )


def _series(spark: SparkSession, d: str) -> DataFrame:
    o = st.table(spark, d, "orders").where("o_custkey % 12 <> 5")
    return o.groupBy(F.concat(F.lit("N"), (F.col("o_custkey") % 12).cast("string")).alias("source"), F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@page(sql(
    "SELECT actor, period, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS intensity, 'institutional_minmax' AS method FROM c WHERE v IS NOT NULL WINDOW w AS (PARTITION BY actor)",
    s=_SERIES, a=_ACTORS, q=_QUARTERS, k=f"SELECT source, CAST(date_trunc('quarter', date) AS DATE) AS period, {_LAST_OF.format('value')} AS value FROM s GROUP BY ALL",
    f="SELECT actor, transform, period, last_value(value IGNORE NULLS) OVER (PARTITION BY actor ORDER BY period) AS v FROM (SELECT * FROM a WHERE source IN (SELECT source FROM s)) CROSS JOIN q LEFT JOIN k USING (source, period)",
    c="SELECT actor, period, CASE WHEN transform = 'cumulative_change' THEN v - first_value(v IGNORE NULLS) OVER (PARTITION BY actor ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE v END AS v FROM f",
), dates="period")
def series_intensities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(european.series_intensities(_series(spark, d), _actors(spark), _FIRST, _LAST, "institutional_minmax"), "intensity")


@page(sql(
    "SELECT actor AS actor_id, actor AS name, CASE WHEN layer = 0 THEN 'global_shock' WHEN actor LIKE '%ecb%' OR actor LIKE '%boe%' THEN 'central_bank' ELSE 'intl_org' END AS actor_type, layer, CASE WHEN layer = 0 OR actor LIKE '%ecb%' THEN 'EU' WHEN actor LIKE '%boe%' THEN 'UK' ELSE 'GLOBAL' END AS geography, 'macro' AS sector, CASE WHEN layer = 0 THEN 'series=' || source ELSE '' END AS ids FROM a "
    "UNION ALL SELECT 'S' || actor || '.X' || actor % 3, CASE WHEN actor % 7 = 0 THEN 'S' || actor ELSE name END, 'sector_leader', 2, CASE WHEN actor % 5 = 0 THEN 'EU' ELSE geography END, sector, 'exchange=X' || actor % 3 || CASE WHEN actor % 2 = 0 THEN ',isin=I' || actor ELSE '' END || ',ticker=S' || actor FROM registry",
    "registry", a=_ACTORS,
))
def registry_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows built, written as one JSON registry, and scanned again."""
    r, a = st.registry(spark, d), F.col("actor")
    firms = r.select(
        F.concat(F.lit("S"), a.cast("string")).alias("ticker"), F.concat(F.lit("X"), (a % 3).cast("string")).alias("exchange"), F.when(a % 7 != 0, F.col("name")).alias("name"),
        F.when(a % 5 != 0, F.col("geography")).alias("country"), "sector", F.when(a % 2 == 0, F.concat(F.lit("I"), a.cast("string"))).alias("isin"),
    )
    rows = european.registry_rows(firms, _actors(spark).select("*", F.col("actor").alias("name"), F.lit("macro").alias("sector")))
    path = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    U.write_registry(rows.withColumn("position", F.monotonically_increasing_id()), path, version=1)
    back = U.read_registry(spark, path)
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("external_ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return back.select("actor_id", "name", "actor_type", "layer", "geography", "sector", F.coalesce(ids, F.lit("")).alias("ids"))


@page(sql(
    "SELECT n_name AS experiment, c AS \"check\", needed, ready FROM (SELECT n_name, unnest(['registry', 'intensities', 'source billing', 'source site']) AS c, unnest(['r' || n_regionkey, 'i' || n_nationkey || '|x' || n_regionkey, 'billing', 'site']) AS needed, unnest([n_regionkey < 4, n_nationkey % 2 = 0 OR n_regionkey = 1, true, true]) AS ready, unnest([0, 0, 0, 1]) AS odd, n_nationkey FROM nation) WHERE odd = 0 OR n_nationkey % 3 = 0 "
    "UNION ALL SELECT n_name, 'source never', 'never', false FROM nation WHERE n_nationkey % 3 = 1",
))
def experiment_readiness(spark: SparkSession, d: str) -> DataFrame:
    """A plan of an experiment a nation, against registries, intensity tables and the observations' sources that are there."""
    n, k = st.table(spark, d, "nation"), F.col("n_nationkey")
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    more = F.when(k % 3 == 0, F.array(F.lit("billing"), F.lit("site"))).when(k % 3 == 1, F.array(F.lit("billing"), F.lit("never"))).otherwise(F.array(F.lit("billing")))
    plan = n.select(F.col("n_name").alias("experiment"), text("r", "n_regionkey").alias("registry"), F.array(text("i", "n_nationkey"), text("x", "n_regionkey")).alias("intensities"), more.alias("sources"))
    there = n.where("n_regionkey < 4").select(F.lit("registry").alias("kind"), text("r", "n_regionkey").alias("name"))
    there = there.unionByName(n.where("n_nationkey % 2 = 0").select(F.lit("intensities").alias("kind"), text("i", "n_nationkey").alias("name"))).unionByName(n.where("n_regionkey = 1").select(F.lit("intensities").alias("kind"), text("x", "n_regionkey").alias("name")))
    there = there.unionByName(st.observations(spark, d).select(F.lit("source").alias("kind"), F.col("source").alias("name")))
    return european.readiness(plan, there)
