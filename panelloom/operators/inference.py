"""Resampling and serial dependence of series of a few dozen values, such as one difference a window; draws run side by side.

A series is one array a group; draws are rows, so a thousand of them over many series spread over a cluster. Draws are numbered, and a
number's values come from whole-number arithmetic alone: the same on any engine, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the prime below which draws are whole numbers.
PRIME = 2_147_483_647
SEED = 42


def drawn(draw: Column, place: Column, n: Column, seed: int = SEED) -> Column:
    """A whole number from 0 to n - 1 for each (draw, place): squares modulo a prime, three times over."""
    a = (draw.cast("long") * 7919 + place.cast("long") * 104_729 + seed) % PRIME
    b = (a * a + 12_345) % PRIME
    c = (b * b + a) % PRIME
    return ((c * c + b) % PRIME) % n


def series(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(*by, xs, n): each group's non-null values in order."""
    kept = rows.where(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("x__")))), lambda x: x["x__"]).alias("xs")).withColumn("n", F.size("xs"))


def _draws(of: DataFrame, draws: int) -> DataFrame:
    return of.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def resampled(of: DataFrame, draws: int = 10_000, block: int = 1) -> DataFrame:
    """(..., draw, ys): values drawn again, singly or as moving blocks of ``block`` cut to the series' length."""
    at = lambda i: drawn(F.col("draw"), F.floor(i / F.lit(block)), F.greatest(F.col("n") - (block - 1), F.lit(1))) + i % block
    return _draws(of, draws).withColumn("ys", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("xs", at(i).cast("int"))))


def bootstrap_interval(of: DataFrame, by: list[str], draws: int = 10_000, block: int = 1, level: float = 0.95) -> DataFrame:
    """(*by, n, mean, low, high): percentile interval of the mean. Series shorter than a block have none."""
    means = resampled(of.where(F.col("n") >= block), draws, block).withColumn("m", _total(F.col("ys")) / F.col("n"))
    low, high = (F.percentile("m", F.lit(p)) for p in ((1 - level) / 2, (1 + level) / 2))
    return means.groupBy(*by).agg(F.first("n").alias("n"), F.first(_total(F.col("xs")) / F.col("n")).alias("mean"), low.alias("low"), high.alias("high"))


def bootstrap_sharpe(of: DataFrame, by: list[str], draws: int = 10_000, periods: int = 4, level: float = 0.95) -> DataFrame:
    """(*by, n, low, high): percentile interval of the annual Sharpe ratio; draws without spread count as 0."""
    mean = _total(F.col("ys")) / F.col("n")
    rows = resampled(of.where("n > 1"), draws).withColumn("m", mean)
    sd = F.sqrt(F.aggregate("ys", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (F.col("n") - 1))
    rows = rows.withColumn("sd", sd).withColumn("s", F.when(F.col("sd") > 1e-15, F.col("m") / F.col("sd") * periods**0.5).otherwise(F.lit(0.0)))
    low, high = (F.percentile("s", F.lit(p)) for p in ((1 - level) / 2, (1 + level) / 2))
    return rows.groupBy(*by).agg(F.first("n").alias("n"), low.alias("low"), high.alias("high"))


def sign_flip(of: DataFrame, by: list[str], draws: int = 9_999) -> DataFrame:
    """(*by, n, mean, p): one-sided p of a mean above 0 under random signs."""
    flipped = F.transform("xs", lambda x, i: x * (2 * drawn(F.col("draw"), i, F.lit(2)) - 1))
    rows = _draws(of.withColumn("mean", _total(F.col("xs")) / F.col("n")), draws).withColumn("m", _total(flipped) / F.col("n"))
    # A draw equal to the mean counts, whatever its last bit.
    hits = F.count_if(F.col("m") >= F.col("mean") - 1e-12)
    return rows.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), ((hits + 1) / F.lit(draws + 1)).alias("p"))


def holm(tests: DataFrame, p: str = "p", ties: str = "arch") -> DataFrame:
    """``tests`` with ``holm``: p values adjusted by Holm and Bonferroni; one row a test, a few dozen."""
    w = Window.orderBy(p, ties)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("step__", step).withColumn("holm", F.max("step__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step__")


def ljung_box(rows: DataFrame, by: list[str], order: str, value: str, lags: int = 8) -> DataFrame:
    """(*by, n, q, p): Q of the autocorrelations up to ``lags``, an even number; no variance gives (0, 1), fewer values than lags are left out."""
    seq, group = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    d = rows.where(F.col(value).isNotNull()).withColumn("d__", F.col(value) - F.avg(value).over(group))
    for k in range(1, lags + 1):
        d = d.withColumn(f"g{k}__", F.col("d__") * F.lag("d__", k).over(seq))
    n, var = F.count("d__"), F.sum(F.col("d__") * F.col("d__"))
    sums = d.groupBy(*by).agg(n.alias("n"), var.alias("var"), *(F.sum(f"g{k}__").alias(f"g{k}") for k in range(1, lags + 1))).where(F.col("n") > lags)
    q = F.col("n") * (F.col("n") + 2) * sum(((F.col(f"g{k}") / F.col("var")) ** 2 / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    out = sums.withColumn("q", F.when(F.col("var") >= 1e-15 * F.col("n"), q).otherwise(F.lit(0.0)))
    # The tail of chi squared with an even number of degrees of freedom is a finite sum.
    term, tail = F.lit(1.0), F.lit(1.0)
    for j in range(1, lags // 2):
        term = term * F.col("q") / 2 / j
        tail = tail + term
    return out.select(*by, "n", "q", (F.exp(-F.col("q") / 2) * tail).alias("p"))


def variance_ratio(rows: DataFrame, by: list[str], order: str, value: str, q: int = 4) -> DataFrame:
    """(*by, ratio): variance of q-step changes over q times that of single ones; null without variance."""
    seq = Window.partitionBy(*by).orderBy(order)
    d = rows.where(F.col(value).isNotNull()).withColumn("one__", F.col(value) - F.lag(value).over(seq)).withColumn("q__", F.col(value) - F.lag(value, q).over(seq))
    one = F.var_samp("one__")
    return d.groupBy(*by).agg(F.when(one > 0, F.var_samp("q__") / (q * one)).alias("ratio"))
