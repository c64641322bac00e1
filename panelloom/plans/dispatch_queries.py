"""Registry-wide intensities with fallbacks, on stand-ins: suppliers of three layers, five sources with holes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import semantics as S
from panelloom.operators import dispatch
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded
from panelloom.plans.standins import sql

BOOK = Book()
page = BOOK.page

_FIRST, _LAST = dt.date(1995, 1, 1), dt.date(2001, 10, 1)


def actors(spark: SparkSession, d: str) -> DataFrame:
    """Layer 2's actors are banks or firms; the region AMERICA is the home market."""
    kind = F.when(F.col("layer") == 0, "global_shock").when(F.col("layer") == 1, "central_bank").when(F.col("actor") % 4 == 0, "bank").otherwise("large_firm")
    home = F.when(F.col("sector") == "AMERICA", "US").otherwise(F.col("sector"))
    return st.registry(spark, d).select("actor", "layer", kind.alias("actor_type"), home.alias("geography"), "sector")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Series, news and assets by number of the actor, capital spending of two thirds of the actors, prices of four fifths; each with missing quarters."""
    q, a = S.quarter(F.col("l_shipdate")).alias("period"), F.col("l_suppkey").alias("actor")
    g = st.table(spark, d, "lineitem").groupBy(a, q).agg(
        F.avg("l_tax").alias("series"), F.count(F.lit(1)).cast("double").alias("news"), F.sum("l_quantity").alias("assets"), F.avg("l_discount").alias("capex_ratio"), F.avg("l_extendedprice").alias("prices"),
    )
    long = g.unpivot(["actor", "period"], ["series", "news", "assets", "capex_ratio", "prices"], "source", "value")
    there = F.when(F.col("source") == "news", F.col("actor") % 2 == 0).when(F.col("source") == "capex_ratio", F.col("actor") % 3 != 0).when(F.col("source") == "prices", F.col("actor") % 5 != 0).otherwise(F.lit(True))
    hole = (F.col("actor") + F.year("period") * 4 + F.quarter("period") + F.length("source")) % 9 == 0
    return long.where(there & ~hole).withColumn("value", F.round("value", 9))


_SQL = {
    "actors_": "SELECT actor, layer, CASE WHEN layer = 0 THEN 'global_shock' WHEN layer = 1 THEN 'central_bank' WHEN actor % 4 = 0 THEN 'bank' ELSE 'large_firm' END AS actor_type, CASE WHEN sector = 'AMERICA' THEN 'US' ELSE sector END AS geography FROM registry",
    "wide_": "SELECT l_suppkey AS actor, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, avg(l_tax) AS series, CAST(count(*) AS DOUBLE) AS news, sum(l_quantity) AS assets, avg(l_discount) AS capex_ratio, avg(l_extendedprice) AS prices FROM lineitem GROUP BY 1, 2",
    "long_": "SELECT actor, period, source, round(value, 9) AS value FROM (UNPIVOT wide_ ON series, news, assets, capex_ratio, prices INTO NAME source VALUE value) WHERE CASE source WHEN 'news' THEN actor % 2 = 0 WHEN 'capex_ratio' THEN actor % 3 <> 0 WHEN 'prices' THEN actor % 5 <> 0 ELSE true END AND (actor + year(period) * 4 + quarter(period) + length(source)) % 9 <> 0",
    "rules_": "SELECT * FROM (VALUES ('series_minmax', 'series', 1), ('news_minmax', 'news', 1), ('rate_minmax', 'series', 2), ('asset_growth_rank', 'assets', 1), ('capital_spending_rank', 'capex_ratio', 1), ('return_12m_rank', 'prices', 2)) AS r(method, source, rank)",
    "asked_": "SELECT a.*, r.*, CAST(p AS DATE) AS period FROM actors_ a JOIN rules_ r ON CASE method WHEN 'series_minmax' THEN layer = 0 WHEN 'news_minmax' THEN layer = 1 WHEN 'rate_minmax' THEN layer = 1 WHEN 'asset_growth_rank' THEN actor_type = 'bank' WHEN 'capital_spending_rank' THEN actor_type = 'large_firm' ELSE actor_type = 'large_firm' AND geography <> 'US' END, (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTHS)) AS p)",
    "full_": "SELECT asked_.*, CASE WHEN method = 'news_minmax' THEN value ELSE last_value(value IGNORE NULLS) OVER (PARTITION BY actor, method ORDER BY period) END AS v FROM asked_ LEFT JOIN long_ USING (actor, source, period)",
    "measured_": "SELECT *, CASE WHEN method IN ('asset_growth_rank', 'return_12m_rank') THEN v / nullif(lag(v, 4) OVER (PARTITION BY actor, method ORDER BY period), 0) - 1 ELSE v END AS m FROM full_",
}


def _found(unit: str) -> dict[str, str]:
    rank = "(rank() OVER (PARTITION BY method, period, pool ORDER BY m NULLS LAST) + (count(m) OVER (PARTITION BY method, period, pool, m) - 1) / 2) / count(m) OVER (PARTITION BY method, period, pool)"
    span = "(m - min(m) OVER (PARTITION BY actor, method)) / nullif(max(m) OVER (PARTITION BY actor, method) - min(m) OVER (PARTITION BY actor, method), 0)"
    return _SQL | {
        "won_": f"SELECT *, CASE WHEN method = 'return_12m_rank' THEN geography ELSE '' END AS pool FROM (SELECT *, min(CASE WHEN m IS NOT NULL THEN rank END) OVER (PARTITION BY {unit}) AS best FROM measured_) WHERE rank = best",
        "found_": f"SELECT actor, period, CASE WHEN m IS NULL THEN NULL WHEN method LIKE '%_rank' THEN {rank} ELSE {span} END AS intensity, method, source, rank FROM won_",
    }


def _intensities(spark: SparkSession, d: str, wins: str) -> DataFrame:
    return dispatch.intensities(actors(spark, d), sources(spark, d), _FIRST, _LAST, wins=wins)


_ROWS = "SELECT actor, period, round(intensity, 6) AS intensity, method, source, rank FROM found_ WHERE intensity IS NOT NULL"


@page(sql(_ROWS, "registry", **_found("actor")), dates="period")
def registry_intensities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_intensities(spark, d, "actor"), "intensity")


@page(sql(_ROWS, "registry", **_found("actor, period")), dates="period")
def registry_intensities_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_intensities(spark, d, "quarter"), "intensity")


@page(sql("SELECT method, source, rank, count(DISTINCT actor) AS n_actors, count(DISTINCT period) AS n_quarters, count(*) AS n FROM found_ WHERE intensity IS NOT NULL GROUP BY ALL", "registry", **_found("actor, period")))
def intensity_provenance(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.provenance(_intensities(spark, d, "quarter"))


@page(sql("SELECT a.*, coalesce(tried, '') AS tried FROM (SELECT actor, actor_type, layer, geography FROM actors_ WHERE actor NOT IN (SELECT actor FROM found_ WHERE intensity IS NOT NULL)) a LEFT JOIN (SELECT actor, string_agg(source, ',' ORDER BY rank, source) AS tried FROM (SELECT DISTINCT actor, source, rank FROM asked_) GROUP BY 1) USING (actor)", "registry", **_found("actor")))
def uncovered_actors(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.uncovered(actors(spark, d), _intensities(spark, d, "actor"))
