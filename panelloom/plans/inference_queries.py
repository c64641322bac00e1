"""Queries of resampling, serial dependence and split samples, and of text sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import inference as I
from panelloom.operators import portfolio as P
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import _DELTA_PARTS, block_deltas, rounded
from panelloom.plans.portfolio_queries import _LS, _PARTS
from panelloom.plans.standins import sql
from panelloom.session import shared_dir
from panelloom.sources import files

BOOK = Book()
page = BOOK.page
_A0 = f"(CAST(draw AS BIGINT) * 7919 + CAST(PLACE AS BIGINT) * 104729 + {I.SEED}) % {I.PRIME}"


def _drawn(place: str, n: str) -> str:
    """As operators.inference.drawn."""
    a = f"({_A0.replace('PLACE', place)})"
    b = f"(({a} * {a} + 12345) % {I.PRIME})"
    c = f"(({b} * {b} + {a}) % {I.PRIME})"
    return f"((({c} * {c} + {b}) % {I.PRIME}) % ({n}))"


def _resampled(source: str, draws: int, block: int = 1) -> str:
    at = f"{_drawn(f'(i // {block})', f'greatest(n - {block - 1}, 1)')} + i % {block}"
    return f"SELECT *, list_transform(range(n), lambda i: xs[CAST({at} AS BIGINT) + 1]) AS ys FROM {source}, (SELECT unnest(range({draws})) AS draw)"


_SERIES = "SELECT arch, list(round(delta, 9) ORDER BY test_year, block) AS xs, count(*) AS n FROM delta_ GROUP BY 1"


def _of_arch(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return I.series(block_deltas(spark, d).withColumn("delta", F.round("delta", 9)), ["arch", *more], ["test_year", "block"], "delta")


def _interval(block: int) -> str:
    return sql(
        "SELECT arch, any_value(n) AS n, round(any_value(list_sum(xs) / n), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT *, list_sum(ys) / n AS m FROM y) GROUP BY 1",
        "preds", **_DELTA_PARTS, s=_SERIES, y=_resampled("s", 10_000, block),
    )


@page(_interval(1))
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.bootstrap_interval(_of_arch(spark, d), ["arch"]).withColumn("n", F.col("n").cast("long")), "mean", "low", "high")


@page(_interval(3))
def block_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.bootstrap_interval(_of_arch(spark, d), ["arch"], block=3).withColumn("n", F.col("n").cast("long")), "mean", "low", "high")


_FLIPS = f"SELECT *, list_sum(xs) / n AS mean, list_sum(list_transform(xs, lambda x, i: x * (2 * {_drawn('(i - 1)', '2')} - 1))) / n AS m FROM s, (SELECT unnest(range(9999)) AS draw)"


@page(sql("SELECT arch, round(any_value(mean), 6) AS mean, round((count(*) FILTER (m >= mean - 1e-12) + 1) / 10000, 6) AS p FROM f GROUP BY 1", "preds", **_DELTA_PARTS, s=_SERIES, f=_FLIPS))
def sign_flip_p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.sign_flip(_of_arch(spark, d), ["arch"]).select("arch", "mean", "p"), "mean", "p")


@page(sql("SELECT arch, block, round(p, 6) AS p, round(max(least(1.0, (k - r + 1) * p)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS holm FROM (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY p, arch || block) AS r FROM (SELECT arch, block, (count(*) FILTER (m >= mean - 1e-12) + 1) / 10000 AS p FROM f GROUP BY 1, 2))", "preds", **_DELTA_PARTS, s=_SERIES.replace("SELECT arch,", "SELECT arch, block,").replace("ORDER BY test_year, block", "ORDER BY test_year").replace("GROUP BY 1", "GROUP BY 1, 2"), f=_FLIPS))
def holm_p(spark: SparkSession, d: str) -> DataFrame:
    one = I.series(block_deltas(spark, d).withColumn("delta", F.round("delta", 9)), ["arch", "block"], ["test_year"], "delta")
    tests = I.sign_flip(one, ["arch", "block"]).withColumn("name", F.concat("arch", "block"))
    return rounded(I.holm(tests, ties="name").select("arch", "block", "p", "holm"), "p", "holm")


_LAGS = ", ".join(f"sum(d * l{k}) AS g{k}" for k in range(1, 9))
_Q = " + ".join(f"pow(g{k} / var, 2) / (n - {k})" for k in range(1, 9))


@page(sql(
    "SELECT actor_id, n, round(q, 4) AS q, round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6), 5) AS p FROM z", "rets",
    x="SELECT *, return_q - avg(return_q) OVER (PARTITION BY actor_id) AS d FROM rets",
    y=f"SELECT actor_id, d, {', '.join(f'lag(d, {k}) OVER (PARTITION BY actor_id ORDER BY quarter) AS l{k}' for k in range(1, 9))} FROM x",
    w=f"SELECT actor_id, count(d) AS n, sum(d * d) AS var, {_LAGS} FROM y GROUP BY 1", z=f"SELECT *, CASE WHEN var >= 1e-15 * n THEN n * (n + 2) * ({_Q}) ELSE 0 END AS q FROM w WHERE n > 8",
))
def ljung_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(I.ljung_box(st.returns(spark, d), ["actor_id"], "quarter", "return_q"), "q", digits=4), "p", digits=5)


@page(sql("SELECT actor, round(CASE WHEN var_samp(a) > 0 THEN var_samp(b) / (4 * var_samp(a)) END, 5) AS ratio FROM (SELECT actor, value - lag(value) OVER w AS a, value - lag(value, 4) OVER w AS b FROM panel WHERE value IS NOT NULL WINDOW w AS (PARTITION BY actor ORDER BY period)) GROUP BY 1", "panel"))
def variance_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.variance_ratio(st.panel(spark, d), ["actor"], "period", "value"), "ratio", digits=5)


def _spread(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("quarter") < F.lit("2000-01-01").cast("date"), "pre").otherwise("post")
    return P.long_short(st.sorted_signal(spark, d)).select("quarter", F.round("spread", 9).alias("r"), part.alias("part"))


_SPREAD = "SELECT quarter, round(spread, 9) AS r, CASE WHEN quarter < DATE '2000-01-01' THEN 'pre' ELSE 'post' END AS part FROM ls"


@page(sql(
    "SELECT part, any_value(n) AS n, round(quantile_cont(s, 0.025), 5) AS low, round(quantile_cont(s, 0.975), 5) AS high FROM (SELECT *, CASE WHEN sd > 1e-15 THEN m / sd * 2 ELSE 0 END AS s FROM (SELECT *, sqrt(list_sum(list_transform(ys, lambda x: (x - m) * (x - m))) / (n - 1)) AS sd FROM (SELECT *, list_sum(ys) / n AS m FROM y))) GROUP BY 1",
    "preds", "rets", **_PARTS, ls=_LS, spread_=_SPREAD, s0="SELECT part, list(r ORDER BY quarter) AS xs, count(*) AS n FROM spread_ GROUP BY 1 HAVING count(*) > 1", y=_resampled("s0", 10_000),
))
def bootstrap_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the spread's Sharpe ratio, before and after a date."""
    out = I.bootstrap_sharpe(I.series(_spread(spark, d), ["part"], ["quarter"], "r"), ["part"])
    return rounded(out.withColumn("n", F.col("n").cast("long")), "low", "high", digits=5)


@page(sql("SELECT part, count(*) AS n, round(pow(exp(sum(ln(1 + r))), 4 / count(*)) - 1, 5) AS ann_return, round(CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * 2 ELSE 0 END, 5) AS sharpe FROM spread_ GROUP BY 1", "preds", "rets", **_PARTS, ls=_LS, spread_=_SPREAD))
def split_performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.performance(_spread(spark, d), ["part"]).select("part", "n", "ann_return", "sharpe"), "ann_return", "sharpe", digits=5)


@page(sql("SELECT quarter, round(avg(return_q), 6) AS r, count(*) AS held FROM rets GROUP BY 1", "rets"), dates="quarter")
def equal_weight(spark: SparkSession, d: str) -> DataFrame:
    """The portfolio without a signal: all actors alike."""
    return rounded(st.returns(spark, d).groupBy("quarter").agg(F.avg("return_q").alias("r"), F.count(F.lit(1)).alias("held")), "r")


# --- sinks: written and read again ---------------------------------------------------------------------------------

for _kind in ("csv", "json", "parquet"):

    def _round_trip(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        panel = st.gappy(spark, d).withColumn("note", F.concat(F.lit('a "quoted", value\n'), F.col("actor").cast("string")))
        files.write(panel, path, kind)
        return rounded(files.read(spark, path, kind, panel.schema), "value")

    BOOK.add(f"{_kind}_round_trip", _round_trip, sql("SELECT actor, period, round(value, 6) AS value, 'a \"quoted\", value' || chr(10) || actor AS note FROM gappy", "gappy"), "period")
