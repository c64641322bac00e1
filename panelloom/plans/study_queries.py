"""Queries of variant grids, held-out selection, leak tests, perturbed targets and registries built in steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import order as O
from panelloom.operators import inference as I
from panelloom.operators import scoring, studies
from panelloom.operators import signals as G
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.inference_queries import _SERIES, _of_arch, _resampled
from panelloom.plans.panel_queries import _DELTA_PARTS, block_deltas, rounded, t_p
from panelloom.plans.portfolio_queries import _HIT, _PARTS, _signal
from panelloom.plans.standins import sql
from panelloom.sources import payloads

BOOK = Book()
page = BOOK.page

# --- grids ----------------------------------------------------------------------------------------------------------------

_WIDTHS = [2, 3, 4, 6, 8]
_SIZES = [3, 5, 6, 8, 10, 12, 15, 20, 25]


def _cells(by: str, signals: str) -> dict[str, str]:
    lead = f"{by}, " if by else ""
    return {
        "matched_": f"SELECT {lead}quarter, actor_id, score, return_q FROM ({signals}) JOIN rets USING (quarter, actor_id) WHERE score IS NOT NULL",
        "ranked": f"SELECT *, count(*) OVER (PARTITION BY {lead}quarter) AS names, row_number() OVER (PARTITION BY {lead}quarter ORDER BY score DESC, actor_id DESC) AS hi, row_number() OVER (PARTITION BY {lead}quarter ORDER BY score, actor_id) AS lo FROM matched_",
        "cells": f"SELECT {lead}n, quarter, avg(return_q) FILTER (hi <= n) AS long, avg(return_q) FILTER (lo <= n) AS short, avg(return_q) AS equal_weight, any_value(names) AS names FROM ranked, (SELECT CAST(unnest({_SIZES}) AS INTEGER) AS n) GROUP BY ALL",
    }


def _sharpe(r: str) -> str:
    return f"CASE WHEN count({r}) > 3 THEN CASE WHEN stddev_samp({r}) > 1e-15 THEN avg({r}) / stddev_samp({r}) * 2 ELSE 0 END END"


_BY_WIDTH = " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS width, quarter, actor_id, round(d * avg(hit) OVER (PARTITION BY actor_id ORDER BY quarter ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 9) AS score FROM hit_" for k in _WIDTHS
)


@page(sql(f"SELECT width, n, count(*) AS quarters, round({_sharpe('(long - short)')}, 4) AS sharpe FROM cells WHERE names >= 2 * n GROUP BY 1, 2", "preds", "rets", hit_=_HIT, **_cells("width", _BY_WIDTH)))
def accuracy_window_grid(spark: SparkSession, d: str) -> DataFrame:
    """Sharpe ratio of top-n spreads for each width of the accuracy window and each n."""
    preds, rets = st.predictions(spark, d), st.returns(spark, d)
    parts = [G.accuracy_scaled(k)(preds, rets).withColumn("score", F.round("score", 9)).withColumn("width", F.lit(k)) for k in _WIDTHS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    cells = studies.top_n_grid(every, rets, ["width"], _SIZES)
    return rounded(cells.groupBy("width", "n").agg(F.count(F.lit(1)).alias("quarters"), studies.sharpe(F.col("long") - F.col("short")).alias("sharpe")), "sharpe", digits=4)


_SCALED = {
    "vol": "SELECT quarter, CASE WHEN count(r) OVER w >= 4 THEN stddev_samp(r) OVER w END AS v FROM (SELECT quarter, avg(return_q) AS r FROM rets GROUP BY 1) WINDOW w AS (ORDER BY quarter ROWS 3 PRECEDING)",
    "scales": "SELECT quarter, CASE WHEN v IS NOT NULL THEN greatest(0.5, least(2.0, (SELECT median(v) FROM vol) / (v + 1e-8))) END AS scale FROM vol",
}
_VOL_SIGNAL = "SELECT quarter, actor_id, round(score * coalesce(scale, 1), 9) AS score FROM sig LEFT JOIN scales USING (quarter)"


@page(sql("SELECT n, quarter, round(long - short, 6) AS spread FROM cells WHERE names >= 2 * n", "preds", "rets", sig=_PARTS["sig"], **_SCALED, **_cells("", _VOL_SIGNAL)), dates="quarter")
def volatility_scaled_grid(spark: SparkSession, d: str) -> DataFrame:
    rets = st.returns(spark, d)
    signal = studies.volatility_scaled(_signal(spark, d), rets).withColumn("score", F.round("score", 9))
    cells = studies.top_n_grid(signal, rets, [], _SIZES)
    return rounded(cells.select("n", "quarter", (F.col("long") - F.col("short")).alias("spread")), "spread")


@page(sql(
    f"SELECT n, part, count(*) AS quarters, round({_sharpe('long')}, 4) AS sharpe, round({_sharpe('(long - equal_weight)')}, 4) AS ir FROM cells, (SELECT unnest(['full', 'pre', 'post']) AS part) WHERE names >= n AND (part = 'full' OR (part = 'pre') = (quarter < DATE '2000-01-01')) GROUP BY 1, 2",
    "preds", "rets", sig=_PARTS["sig"], **_cells("", "SELECT * FROM sig"),
))
def top_n_sub_samples(spark: SparkSession, d: str) -> DataFrame:
    """Top-n portfolios against all names alike: Sharpe and information ratio, over all quarters and on both sides of a date."""
    cells = studies.top_n_grid(_signal(spark, d), st.returns(spark, d), [], _SIZES, sides=1)
    side = F.when(F.col("quarter") < F.lit("2000-01-01").cast("date"), "pre").otherwise("post")
    both = cells.withColumn("part", F.explode(F.array(F.lit("full"), side)))
    out = both.groupBy("n", "part").agg(F.count(F.lit(1)).alias("quarters"), studies.sharpe(F.col("long")).alias("sharpe"), studies.sharpe(F.col("long") - F.col("equal_weight")).alias("ir"))
    return rounded(out, "sharpe", "ir", digits=4)


# --- selection on early years, errors, leaks --------------------------------------------------------------------------------

_CHOSEN = {
    "early": "SELECT block, mean, wins, CASE WHEN wins >= 2 THEN 0 WHEN wins >= 1 THEN 1 ELSE 2 END AS tier FROM (SELECT block, avg(delta) AS mean, count(*) FILTER (delta > 0) AS wins FROM delta_ WHERE arch = 'm2' AND test_year <= 1999 GROUP BY 1) WHERE mean > 0",
    "chosen": "SELECT * FROM early WHERE tier = (SELECT min(tier) FROM early)",
}


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return studies.chosen_units(block_deltas(spark, d).where("arch = 'm2'"), 1999, (2, 1))


@page(sql("SELECT block, round(mean, 6) AS mean, wins, CAST(tier AS INTEGER) AS tier FROM chosen", "preds", **_DELTA_PARTS, **_CHOSEN))
def held_out_selection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_chosen(spark, d), "mean")


@page(sql(
    "SELECT year, round(1 - b / t, 6) AS base_r2, round(1 - m / t, 6) AS mixed_r2, round((b - m) / t, 6) AS delta FROM (SELECT year, sum(pow(actual - pred_g0, 2)) AS b, sum(pow(actual - CASE WHEN c.block IS NOT NULL THEN pred_m2 ELSE pred_g0 END, 2)) AS m, var_pop(actual) * count(*) AS t FROM preds JOIN registry ON actor = actor_id LEFT JOIN chosen c ON c.block = CASE WHEN registry.sector IN ('AMERICA', 'ASIA', 'EUROPE') THEN registry.sector ELSE 'REMAINDER' END WHERE year > 1999 GROUP BY 1)",
    "preds", **_DELTA_PARTS, **_CHOSEN,
))
def held_out_gain(spark: SparkSession, d: str) -> DataFrame:
    """Blocks chosen on early years, frozen, and scored on later ones."""
    own = st.blocks(spark, d).withColumnRenamed("actor", "actor_id")
    preds = st.predictions(spark, d).join(own, "actor_id", "left").withColumn("block", F.coalesce("block", F.lit("REMAINDER")))
    return rounded(studies.frozen_gain(preds, _chosen(spark, d), 1999, "pred_g0", "pred_m2"), "base_r2", "mixed_r2", "delta")


@page(sql("SELECT year, count(*) AS n, round(corr(pow(actual - pred_g1, 2), pow(actual - pred_m2, 2)), 6) AS corr FROM preds GROUP BY 1", "preds"))
def error_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.error_correlation(st.predictions(spark, d), ["year"], "pred_g1", "pred_m2"), "corr")


@page(sql(
    f"SELECT against, n, round(r, 6) AS r, round({t_p('t', '(n - 2)')}, 6) AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT against, count(*) AS n, corr(pred_m2, y) AS r FROM (SELECT 'same' AS against, pred_m2, actual AS y FROM preds UNION ALL SELECT 'lagged', pred_m2, lag(actual) OVER (PARTITION BY actor_id ORDER BY quarter) FROM preds) WHERE y IS NOT NULL GROUP BY 1))",
    "preds",
))
def leak_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.leak_test(st.predictions(spark, d), "pred_m2"), "r", "p")


@page(sql(
    "SELECT arch, round(mean, 6) AS mean, round(low, 6) AS low, mean >= 0.005 AND low > 0 AS won FROM (SELECT arch, any_value(list_sum(xs) / n) AS mean, quantile_cont(m, 0.025) AS low FROM (SELECT *, list_sum(ys) / n AS m FROM y) GROUP BY 1)",
    "preds", **_DELTA_PARTS, s=_SERIES, y=_resampled("s", 10_000),
))
def win_condition(spark: SparkSession, d: str) -> DataFrame:
    x = I.bootstrap_interval(_of_arch(spark, d), ["arch"])
    return rounded(x.select("arch", "mean", "low", scoring.verdict(F.col("mean"), F.col("low")).alias("won")), "mean", "low")


# --- perturbed targets --------------------------------------------------------------------------------------------------------

SIGMAS = [0.0, 0.01, 0.02, 0.05, 0.1]


def _noise(key: str) -> str:
    """As operators.inference.drawn."""
    a = f"((({key}) * 7919 + place * 104729 + {I.SEED}) % {I.PRIME})"
    b = f"(({a} * {a} + 12345) % {I.PRIME})"
    c = f"(({b} * {b} + {a}) % {I.PRIME})"
    return f"((({c} * {c} + {b}) % {I.PRIME}) % {I.PRIME - 1})"


#: The noisy panel's rows from one named panel.
NOISE = {
    "keyed": "SELECT CAST(actor AS BIGINT) AS actor, period, value, CAST(year(period) * 4 + quarter(period) AS BIGINT) AS place FROM panel WHERE value IS NOT NULL",
    "normal": f"SELECT actor, period, value, sqrt(-2 * ln(({_noise('actor')} + 1) / {I.PRIME}::DOUBLE)) * cos(2 * pi() * ({_noise('actor + 1000003')} / {I.PRIME}::DOUBLE)) AS z FROM keyed",
    "noisy_": f"SELECT sigma, actor, period, value, round(CASE WHEN sigma = 0 THEN value ELSE greatest(0, least(1, value + sigma * z)) END, 9) AS noisy FROM normal, (SELECT unnest({SIGMAS})::DOUBLE AS sigma)",
}


@page(sql(
    "SELECT sigma, period, round(corr(r, s), 5) AS rho FROM (SELECT sigma, period, (rank() OVER w + count(*) OVER (PARTITION BY sigma, period, value) / 2) AS r, (rank() OVER v + count(*) OVER (PARTITION BY sigma, period, noisy) / 2) AS s FROM noisy_ WINDOW w AS (PARTITION BY sigma, period ORDER BY value), v AS (PARTITION BY sigma, period ORDER BY noisy)) GROUP BY 1, 2 HAVING count(*) > 5",
    "panel", **NOISE,
), dates="period")
def perturbed_rank_stability(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation, in each quarter, of values with and without noise."""
    x = studies.perturbed(st.panel(spark, d), SIGMAS).withColumn("noisy", F.round("noisy", 9))
    ranked = O.ranked(x, {"r": "value", "s": "noisy"}, ["sigma", "period"], share=True)
    return rounded(ranked.groupBy("sigma", "period").agg(F.corr("r", "s").alias("rho"), F.count(F.lit(1)).alias("n")).where("n > 5").drop("n"), "rho", digits=5)


_OWN = "OVER (PARTITION BY actor_id ORDER BY quarter)"
_LOCAL = "pred_m2 - pred_g1"
_TIMED = " UNION ALL ".join(
    [
        f"SELECT '{c}_{side}_lag{k}' AS variant, quarter, actor_id, {sign} * lag({c}, {k}) {_OWN} AS score FROM base"
        for c, many in (("local", (4, 3)), ("change", (4, 3)), ("level", (3, 3))) for side, sign, n in zip(("high", "low"), (1, -1), many) for k in range(n)
    ]
    + [
        "SELECT 'same_return', quarter, actor_id, return_q FROM rets", f"SELECT 'next_return', quarter, actor_id, lead(return_q) {_OWN} FROM rets",
        f"SELECT 'random', quarter, actor_id, CAST({_noise('actor_id')} AS DOUBLE) FROM (SELECT quarter, CAST(actor_id AS BIGINT) AS actor_id, CAST(year(quarter) * 4 + quarter(quarter) AS BIGINT) AS place FROM rets)",
    ]
)


def _nine_digits(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts whose values end after nine digits, so that any engine ranks their differences alike."""
    return st.predictions(spark, d).withColumn("actual", F.round("actual", 9))


@page(sql(
    f"SELECT variant, n, round(sharpe, 5) AS sharpe, round(ir, 5) AS ir, round(t, 5) AS t, round({t_p('t', '(n - 1)')}, 6) AS p, round(hit_rate, 6) AS hit_rate FROM stats",
    "preds", "rets",
    base=f"SELECT quarter, actor_id, {_LOCAL} AS local, pred_m2 - lag(round(actual, 9)) {_OWN} AS change, pred_m2 AS level FROM preds", timed=_TIMED,
    placed="SELECT variant, quarter, return_q, row_number() OVER (PARTITION BY variant, quarter ORDER BY score, actor_id) AS place, count(*) OVER (PARTITION BY variant, quarter) AS size FROM timed JOIN rets USING (quarter, actor_id) WHERE score IS NOT NULL",
    quarters="SELECT variant, quarter, avg(return_q) FILTER (place > size - greatest(3, floor(size * 0.33))) AS r, avg(return_q) AS ew FROM placed WHERE size >= 4 GROUP BY 1, 2",
    stats="SELECT variant, count(*) AS n, CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * 2 ELSE 0 END AS sharpe, CASE WHEN stddev_samp(r - ew) > 1e-15 THEN avg(r - ew) / stddev_samp(r - ew) * 2 ELSE 0 END AS ir, CASE WHEN stddev_samp(r - ew) > 1e-15 THEN avg(r - ew) / (stddev_samp(r - ew) / sqrt(count(*))) END AS t, avg(CASE WHEN r > ew THEN 1.0 ELSE 0.0 END) AS hit_rate FROM quarters GROUP BY 1 HAVING count(*) >= 4",
))
def timing_variants(spark: SparkSession, d: str) -> DataFrame:
    """All timings of the local component, the predicted change and the level, with foresight, leak and random controls."""
    out = studies.timing_variants(_nine_digits(spark, d), st.returns(spark, d))
    return rounded(rounded(out, "p", "hit_rate"), "sharpe", "ir", "t", digits=5)


@page(sql(
    f"SELECT CAST(lag AS INTEGER) AS lag, n, round(r, 6) AS r, round({t_p('t', '(n - 2)')}, 6) AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT lag, count(*) AS n, corr(x, return_q) AS r FROM cells WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) >= 10))",
    "preds", "rets", both_=f"SELECT quarter, actor_id, return_q, {_LOCAL} AS local FROM preds JOIN rets USING (quarter, actor_id)",
    cells=" UNION ALL ".join(f"SELECT {k} AS lag, return_q, {'lag' if k >= 0 else 'lead'}(local, {abs(k)}) {_OWN} AS x FROM both_" for k in range(-2, 5)),
))
def timing_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.timing_correlations(st.predictions(spark, d), st.returns(spark, d)), "r", "p")


# --- coverage, flows, registries ------------------------------------------------------------------------------------------------


@page(sql("SELECT year(event_date) AS year, count(DISTINCT actor_id) AS n_units, count(DISTINCT (actor_id, signal_id)) AS n_pairs FROM obs GROUP BY 1", "obs"))
def pairs_per_year(spark: SparkSession, d: str) -> DataFrame:
    return studies.years_seen(st.observations(spark, d), "event_date", "actor_id", "signal_id")


@page(sql(
    "SELECT source, a.sector AS source_sector, target, b.sector AS target_sector, round(coefficient, 6) AS coefficient, year, CAST(make_date(year, 12, 31) + 548 AS DATE) AS pub_date FROM (SELECT c_mktsegment AS source, o_orderpriority AS target, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS coefficient FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) LEFT JOIN codes a ON a.code = source LEFT JOIN codes b ON b.code = target WHERE year >= 1997 AND (a.sector IS NOT NULL OR b.sector IS NOT NULL)",
    codes="SELECT c_mktsegment AS code, substr(c_mktsegment, 1, 1) AS sector FROM customer WHERE c_mktsegment < 'H' GROUP BY 1 UNION ALL SELECT o_orderpriority, 'rush' FROM orders WHERE o_orderpriority < '3' GROUP BY 1",
), dates="pub_date")
def labelled_flows(spark: SparkSession, d: str) -> DataFrame:
    """Yearly flows that come as text, labelled at both ends and dated by their publication."""
    orders, customers = st.table(spark, d, "orders"), st.table(spark, d, "customer")
    year = F.year("o_orderdate")
    trade = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("target"), year.alias("year")).agg(F.format_number(F.sum("o_totalprice"), 2).alias("coefficient"))
    segments = customers.where("c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("code"), F.substring("c_mktsegment", 1, 1).alias("sector")).distinct()
    rush = orders.where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("code"), F.lit("rush").alias("sector")).distinct()
    return rounded(studies.labelled_flows(trade.withColumn("year", F.col("year").cast("string")), segments.unionByName(rush), 1997), "coefficient")


@page(sql("SELECT actor, sector, row_number() OVER (PARTITION BY sector ORDER BY actor) - 1 AS sector_rank, cik FROM registry LEFT JOIN (SELECT c_custkey AS actor, c_name AS cik FROM customer WHERE c_mktsegment = 'BUILDING') USING (actor) WHERE size >= 0", "registry"))
def listed_actors(spark: SparkSession, d: str) -> DataFrame:
    firms = st.registry(spark, d)
    ids = st.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("actor"), F.col("c_name").alias("cik"))
    out = studies.listed_actors(firms, firms.where("size < 0"), ids, position="actor")
    return out.select("actor", "sector", F.col("sector_rank").cast("long").alias("sector_rank"), "cik")


@page(sql(
    "SELECT actor, 'base' AS part FROM base UNION ALL SELECT actor, sector FROM (SELECT r.actor, sector, row_number() OVER (PARTITION BY sector ORDER BY coalesce(coverage, 0) DESC, r.actor) AS n FROM registry r LEFT JOIN cover USING (actor)) WHERE n <= CASE sector WHEN 'ASIA' THEN 15 WHEN 'EUROPE' THEN 10 ELSE 0 END AND actor NOT IN (SELECT actor FROM base)",
    "panel", "registry", base="SELECT actor FROM registry WHERE layer = 0", cover="SELECT actor, count(value) AS coverage FROM panel GROUP BY 1",
))
def expanded_registry(spark: SparkSession, d: str) -> DataFrame:
    reg = st.registry(spark, d)
    cover = st.panel(spark, d).groupBy("actor").agg(F.count("value").alias("coverage"))
    return studies.expanded(reg.where("layer = 0"), reg, cover, {"ASIA": 15, "EUROPE": 10})


@page(sql("SELECT actor, sector, dense_rank() OVER (ORDER BY sector) - 1 AS index, (SELECT count(DISTINCT sector) FROM registry) AS n_groups FROM registry", "registry"))
def sector_numbers(spark: SparkSession, d: str) -> DataFrame:
    return studies.group_numbers(st.registry(spark, d).select("actor", "sector")).withColumn("index", F.col("index").cast("long"))


@page(sql("SELECT actor, period FROM (SELECT actor, period FROM panel WHERE year(period) = 2000) ANTI JOIN (SELECT actor_id AS actor, quarter AS period FROM rets WHERE abs(return_q) < 0.2) USING (actor, period)", "panel", "rets"), dates="period")
def not_cached(spark: SparkSession, d: str) -> DataFrame:
    """What a load has to fetch: wanted (actor, quarter) pairs that the cache doesn't hold."""
    cached = st.returns(spark, d).where("abs(return_q) < 0.2").select(F.col("actor_id").alias("actor"), F.col("quarter").alias("period"))
    return payloads.not_stored(st.panel(spark, d).where("year(period) = 2000").select("actor", "period"), cached, ["actor", "period"])
