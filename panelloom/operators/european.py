"""Intensities and registry rows of a universe of statements and series: firms by capital spending, macro and institutional actors by scaled series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import order as O
from panelloom.functions import semantics as S
from panelloom.operators import normalise as N


def _on_quarters(rows: DataFrame, values: list[str], first: dt.date, last: dt.date, limit: int | None) -> DataFrame:
    """(actor, period, *values): of each actor and quarter the last value by date, carried on for ``limit`` quarters (None: to the end)."""
    dated = rows.withColumn("period", S.quarter(F.col("date").cast("timestamp")))
    known = dated.groupBy("actor", "period").agg(*(S.last_known(F.col(v), F.col("date")).alias(v) for v in values))
    every = rows.select("actor").distinct().withColumn("period", F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 3 months"))))
    past = Window.partitionBy("actor").orderBy("period").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    grid = every.join(known, ["actor", "period"], "left")
    return grid.select("actor", "period", *(F.last(v, ignorenulls=True).over(past).alias(v) for v in values))


def firm_intensities(statements: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(actor, period, intensity, method) of ``statements`` (ticker, exchange, statement, date, total_assets, capex).

    Assets from balance sheets (BS), spending from cash flows (CF), each a quarter old at most; the ratio's absolute value, at most 1, ranked within the quarter.
    """
    own = statements.withColumn("actor", F.concat_ws(".", "ticker", "exchange")).select(
        "actor", "date", F.when(F.col("statement") == "BS", F.col("total_assets")).alias("assets"), F.when(F.col("statement") == "CF", F.col("capex")).alias("capex"),
    )
    ratio = N.capex_ratio(_on_quarters(own, ["assets", "capex"], first, last, 1), signed=True)
    ranked = O.ranked(ratio, {"intensity": "ratio"}, "period", share=True)
    return ranked.where("intensity is not null").select("actor", "period", "intensity", F.lit("capex_assets_xsrank").alias("method"))


def series_intensities(series: DataFrame, actors: DataFrame, first: dt.date, last: dt.date, method: str) -> DataFrame:
    """(actor, period, intensity, method) of ``series`` (source, date, value) for ``actors`` (actor, source, transform).

    Last values of quarters, carried on to the end. transform cumulative_change takes the first known value off; both are scaled to the actor's
    least and greatest quarter. A constant series and an actor without a series have no rows. One source may serve several actors.
    """
    rows = actors.join(series, "source").select("actor", "date", "value")
    q = _on_quarters(rows, ["value"], first, last, None).join(actors.select("actor", "transform"), "actor")
    start = F.first("value", ignorenulls=True).over(Window.partitionBy("actor").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    changed = q.withColumn("value", F.when(F.col("transform") == "cumulative_change", F.col("value") - start).otherwise(F.col("value")))
    scaled = N.time_series_minmax(changed, "intensity").where("intensity is not null")
    return scaled.select("actor", "period", "intensity", F.lit(method).alias("method"))


def registry_rows(firms: DataFrame, series: DataFrame) -> DataFrame:
    """Registry rows (actor_id, name, actor_type, layer, geography, sector, external_ids).

    ``firms`` (ticker, exchange, name, country, sector, isin): layer 2, named by ticker and exchange; without a country EU, without a sector diversified.
    ``series`` (actor, name, source, layer 0 or 1, sector): macro series are of the EU and keep their source's id; institutions are central banks
    where their id names one (ecb, boe), else international, and of the EU, the UK or no single place.
    """
    ids = F.map_filter(F.create_map(F.lit("ticker"), F.col("ticker"), F.lit("exchange"), F.col("exchange"), F.lit("isin"), F.col("isin")), lambda _, v: v.isNotNull())
    of_firms = firms.select(
        F.concat_ws(".", "ticker", "exchange").alias("actor_id"), F.coalesce("name", "ticker").alias("name"), F.lit("sector_leader").alias("actor_type"), F.lit(2).alias("layer"),
        F.coalesce("country", F.lit("EU")).alias("geography"), F.coalesce("sector", F.lit("diversified")).alias("sector"), ids.alias("external_ids"),
    )
    macro, ecb, boe = F.col("layer") == 0, F.col("actor").contains("ecb"), F.col("actor").contains("boe")
    kind = F.when(macro, "global_shock").when(ecb | boe, "central_bank").otherwise("intl_org")
    place = F.when(macro | ecb, "EU").when(boe, "UK").otherwise("GLOBAL")
    source = F.when(macro, F.create_map(F.lit("series"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>"))
    of_series = series.select(F.col("actor").alias("actor_id"), "name", kind.alias("actor_type"), F.col("layer").cast("int").alias("layer"), place.alias("geography"), "sector", source.alias("external_ids"))
    return of_series.unionByName(of_firms)


def readiness(plan: DataFrame, present: DataFrame) -> DataFrame:
    """(experiment, check, needed, ready) of ``plan`` (experiment, registry, intensities, sources) and what is ``present`` (kind, name).

    An experiment needs its registry, one of the ``intensities`` tables it names, and its ``sources``. present has the kinds registry, intensities and source; a
    check is ready if any of the names it accepts is there, and needs nothing if it accepts none.
    """
    each = F.transform("sources", lambda s: F.struct(F.concat(F.lit("source "), s).alias("check"), F.lit("source").alias("kind"), F.array(s).alias("names")))
    one = F.array(F.struct(F.lit("registry").alias("check"), F.lit("registry").alias("kind"), F.array("registry").alias("names")), F.struct(F.lit("intensities").alias("check"), F.lit("intensities").alias("kind"), F.col("intensities").alias("names")))
    asked = plan.select("experiment", F.inline(F.concat(one, each)))
    hits = asked.select("experiment", "check", "kind", F.explode("names").alias("name")).join(present.select("kind", "name").distinct(), ["kind", "name"], "left_semi").select("experiment", "check").distinct()
    ready = asked.join(hits.withColumn("hit__", F.lit(True)), ["experiment", "check"], "left")
    return ready.select("experiment", "check", F.array_join("names", "|").alias("needed"), (F.coalesce("hit__", F.lit(False)) | (F.size("names") == 0)).alias("ready"))
