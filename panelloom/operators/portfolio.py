"""Portfolios from signals: sorts, spreads, turnover and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import order as O
from panelloom.functions import semantics as S

PERIODS = 4


def quarterly_returns(prices: DataFrame) -> DataFrame:
    """(quarter, actor_id, return_q) from (actor_id, ts, price): change of each quarter's last price, first quarters dropped."""
    last = prices.groupBy("actor_id", S.quarter(F.col("ts")).alias("quarter")).agg(S.last_known(F.col("price"), F.col("ts")).alias("close"))
    before = F.lag("close").over(Window.partitionBy("actor_id").orderBy("quarter"))
    return last.withColumn("return_q", F.when(before != 0, F.col("close") / before - 1)).where("return_q is not null").select("quarter", "actor_id", "return_q")


def matched(signal: DataFrame, returns: DataFrame) -> DataFrame:
    return signal.join(returns.select("quarter", "actor_id", "return_q"), ["quarter", "actor_id"]).where("score is not null and return_q is not null")


def quintile_sort(signal: DataFrame, returns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``: columns that tell signals apart which are sorted side by side."""
    return O.quantile_bucket(matched(signal, returns), "score", [*(by or []), "quarter"], "quintile")


def long_short(sorted_: DataFrame, top: int = 5, bottom: int = 1, by: list[str] | None = None) -> DataFrame:
    """(*by, quarter, long, short, spread). If no quarter at all has the top or bottom bucket, the greatest or least one there is stands in."""
    by = by or []
    ends = sorted_.groupBy(*by).agg(F.max("quintile").alias("hi"), F.min("quintile").alias("lo"), F.max(F.col("quintile") == top).alias("has_top"), F.max(F.col("quintile") == bottom).alias("has_bottom"))
    x = (sorted_.join(ends, by) if by else sorted_.crossJoin(F.broadcast(ends))).withColumn("t", F.when(F.col("has_top"), F.lit(top)).otherwise(F.col("hi"))).withColumn("b", F.when(F.col("has_bottom"), F.lit(bottom)).otherwise(F.col("lo")))
    g = x.groupBy(*by, "quarter").agg(F.avg(F.when(F.col("quintile") == F.col("t"), F.col("return_q"))).alias("long"), F.avg(F.when(F.col("quintile") == F.col("b"), F.col("return_q"))).alias("short"))
    return g.where("long is not null and short is not null").withColumn("spread", F.col("long") - F.col("short"))


def long_only(sorted_: DataFrame, top: int = 5, by: list[str] | None = None) -> DataFrame:
    """(*by, quarter, long, equal_weight, active)."""
    g = sorted_.groupBy(*(by or []), "quarter").agg(F.avg(F.when(F.col("quintile") == top, F.col("return_q"))).alias("long"), F.avg("return_q").alias("equal_weight"))
    return g.where("long is not null").withColumn("active", F.col("long") - F.col("equal_weight"))


def turnover(holdings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, quarter, turnover) of (*by, quarter, actor_id): 1 less what is kept over the larger of this and the last holding; 1 at the start."""
    by = by or []
    sets = holdings.groupBy(*by, "quarter").agg(F.collect_set("actor_id").alias("now"))
    w = Window.partitionBy(*by).orderBy("quarter")  # one row a quarter
    was = F.coalesce(F.lag("now").over(w), F.array().cast(sets.schema["now"].dataType))
    kept = F.size(F.array_intersect("now", "was"))
    return sets.withColumn("was", was).select(*by, "quarter", F.when(F.size("was") == 0, F.lit(1.0)).otherwise(1 - kept / F.greatest(F.size("now"), F.size("was"))).alias("turnover"))


def top_n(signal: DataFrame, returns: DataFrame, n: int | None = None, fraction: float | None = None, least: int = 1, sides: int = 2) -> DataFrame:
    """(quarter, long, short, equal_weight, held): means of the n highest and lowest scores; ties by actor_id.

    ``fraction``: n = max(``least``, whole part of fraction * names). Quarters with fewer than ``sides`` * n names are left out.
    """
    x = matched(signal, returns).withColumn("names", F.count(F.lit(1)).over(Window.partitionBy("quarter")))
    size = F.lit(n) if n is not None else F.greatest(F.lit(least), F.floor(F.col("names") * F.lit(fraction)).cast("int"))
    x = x.withColumn("n", size).withColumn("hi", F.row_number().over(Window.partitionBy("quarter").orderBy(F.col("score").desc(), F.col("actor_id").desc()))).withColumn("lo", F.row_number().over(Window.partitionBy("quarter").orderBy("score", "actor_id")))
    x = x.where(F.col("names") >= sides * F.col("n"))
    return x.groupBy("quarter").agg(
        F.avg(F.when(F.col("hi") <= F.col("n"), F.col("return_q"))).alias("long"), F.avg(F.when(F.col("lo") <= F.col("n"), F.col("return_q"))).alias("short"),
        F.avg("return_q").alias("equal_weight"), F.first("n").alias("held"),
    )


def lagged(signal: DataFrame, k: int = 1) -> DataFrame:
    """Scores ``k`` quarters late (negative: early, which leaks)."""
    w = Window.partitionBy("actor_id").orderBy("quarter")
    return signal.withColumn("score", F.lag("score", k).over(w) if k >= 0 else F.lead("score", -k).over(w)).where("score is not null")


def persistent(signal: DataFrame) -> DataFrame:
    """Scores whose sign is that of the quarter before."""
    before = F.lag("score").over(Window.partitionBy("actor_id").orderBy("quarter"))
    return signal.withColumn("b__", before).where(F.signum("score") == F.signum("b__")).drop("b__")


def sector_rotation(signal: DataFrame, sectors: DataFrame, returns: DataFrame, heavy: float = 0.7) -> DataFrame:
    """(quarter, rotated, equal_weight): ``heavy`` on sectors whose lagged mean score exceeds that series' median, the rest on the others."""
    agg = matched(signal, returns).join(sectors.select("actor_id", "sector"), "actor_id").groupBy("quarter", "sector").agg(F.avg("score").alias("s"), F.avg("return_q").alias("r"))
    agg = agg.withColumn("s", F.lag("s").over(Window.partitionBy("sector").orderBy("quarter"))).where("s is not null")
    flagged = agg.withColumn("up", F.col("s") > F.median("s").over(Window.partitionBy("sector")))
    g = flagged.groupBy("quarter").agg(F.avg(F.when(F.col("up"), F.col("r"))).alias("a"), F.avg(F.when(~F.col("up"), F.col("r"))).alias("b"), F.avg("r").alias("equal_weight"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return g.select("quarter", F.when(both, heavy * F.col("a") + (1 - heavy) * F.col("b")).otherwise(F.coalesce("a", "b")).alias("rotated"), "equal_weight")


# --- performance of a series (by..., quarter, r) -------------------------------------------------------------


def _ordered(series: DataFrame, by: list[str], order: str, r: str) -> DataFrame:
    """One array a series, in order: a series has one value a quarter."""
    return series.where(F.col(r).isNotNull()).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(r).cast("double").alias("r__")))), lambda x: x["r__"]).alias("rs"))


def drawdown(rs: Column) -> Column:
    """Largest fall of the compounded series from its highest value so far; the peak starts at the first compounded value, not at 1."""
    start = F.struct(F.lit(1.0).alias("c"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("d"))

    def step(acc: Column, r: Column) -> Column:
        c = acc["c"] * (1 + r)
        peak = F.greatest(acc["peak"], c)
        return F.struct(c.alias("c"), peak.alias("peak"), F.greatest(acc["d"], F.when(peak > 0, (peak - c) / peak).otherwise(F.lit(0.0))).alias("d"))

    return F.aggregate(rs, start, step, lambda acc: acc["d"])


def performance(series: DataFrame, by: list[str], order: str = "quarter", r: str = "r", rf: float = 0.0) -> DataFrame:
    """(*by, n, ann_return, ann_vol, sharpe, max_drawdown, calmar, hit_rate, skew, kurt, psr).

    A compounded value of 0 or less annualises to 0; without volatility Sharpe is 0. The risk-free rate compounds to the
    quarter. PSR joins the annual Sharpe with per-quarter moments; 0.5 below three quarters, else 0 or 1 by sign where its variance isn't positive.
    """
    quarterly = (1 + rf) ** (1 / PERIODS) - 1
    total = F.aggregate("rs", F.lit(1.0), lambda acc, x: acc * (1 + x))
    arrays = _ordered(series, by, order, r).select(*by, total.alias("cum"), drawdown(F.col("rs")).alias("max_drawdown"))
    x = F.col(r).cast("double")
    sd = F.stddev_samp(x)
    stats = series.where(F.col(r).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(sd, F.lit(0.0)).alias("sd"), F.avg(x).alias("mean"), F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"),
    )
    out = stats.join(arrays, by)
    ann = F.when(F.col("cum") > 0, F.pow("cum", PERIODS / F.col("n")) - 1).otherwise(F.lit(0.0))
    sharpe = F.when(F.col("sd") > 1e-15, (F.col("mean") - quarterly) / F.col("sd") * F.sqrt(F.lit(float(PERIODS)))).otherwise(F.lit(0.0))
    out = out.withColumn("ann_return", ann).withColumn("ann_vol", F.col("sd") * F.sqrt(F.lit(float(PERIODS)))).withColumn("sharpe", sharpe)
    se2 = (1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2) / (F.col("n") - 1)
    psr = F.when((F.col("n") < 3) | F.col("skew").isNull(), F.lit(0.5)).when(se2 > 0, S.normal_cdf(F.col("sharpe") / F.sqrt(se2))).when(F.col("sharpe") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    calmar = F.when(F.col("max_drawdown") > 0, F.col("ann_return") / F.col("max_drawdown")).otherwise(F.lit(0.0))
    return out.select(*by, "n", "ann_return", "ann_vol", "sharpe", "max_drawdown", calmar.alias("calmar"), "hit_rate", "skew", "kurt", psr.alias("psr"))


def information_ratio(series: DataFrame, by: list[str], active: str = "active") -> DataFrame:
    """(*by, ir, t, n) of active returns."""
    sd, n = F.stddev_samp(active), F.count(active)
    return series.groupBy(*by).agg(F.when(sd > 1e-15, F.avg(active) / sd * F.sqrt(F.lit(float(PERIODS)))).otherwise(F.lit(0.0)).alias("ir"), F.when(sd > 1e-15, F.avg(active) / (sd / F.sqrt(n))).alias("t"), n.alias("n"))


def cumulative(series: DataFrame, by: list[str], column: str = "active", order: str = "quarter") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("cumulative", S.compound(F.col(column), w, 1))


def net_of_costs(series: DataFrame, turns: DataFrame, bps: float, r: str = "spread") -> DataFrame:
    """Returns less turnover * 2 * cost."""
    return series.join(turns, "quarter").withColumn("net", F.col(r) - F.col("turnover") * 2 * bps / 10_000)


def monotonicity(sorted_: DataFrame) -> DataFrame:
    """(quintile, mean return, rises): does each bucket's mean exceed that of the bucket below?"""
    m = sorted_.groupBy("quintile").agg(F.avg("return_q").alias("mean"))
    return m.withColumn("rises", F.col("mean") > F.lag("mean").over(Window.orderBy("quintile")))  # at most as many rows as buckets


def regime_rotation(hits: DataFrame, groups: DataFrame, heavy: float = 0.7, width: int = 4) -> DataFrame:
    """(quarter, lag_hit, overweight, underweight, equal_weight) from (quarter, hit) rows and (quarter, inside, return_q) rows.

    The group is overweight in quarters whose trailing mean hit rate, one quarter late, reaches the median of that series; the
    other column does the reverse. Quarters without a lagged rate or one of the groups are left out.
    """
    rate = hits.groupBy("quarter").agg(F.avg("hit").alias("h"))
    w = Window.orderBy("quarter")  # one row a quarter
    rate = rate.withColumn("lag_hit", F.avg("h").over(w.rowsBetween(-width, -1)))
    r = groups.groupBy("quarter").agg(F.avg(F.when(F.col("inside"), F.col("return_q"))).alias("a"), F.avg(F.when(~F.col("inside"), F.col("return_q"))).alias("b"), F.avg("return_q").alias("equal_weight"))
    x = rate.join(r, "quarter").where("lag_hit is not null and a is not null and b is not null")
    up = x.crossJoin(F.broadcast(x.agg(F.median("lag_hit").alias("m")))).withColumn("up", F.col("lag_hit") >= F.col("m"))
    mix = lambda flag: F.when(flag, heavy * F.col("a") + (1 - heavy) * F.col("b")).otherwise((1 - heavy) * F.col("a") + heavy * F.col("b"))
    return up.select("quarter", "lag_hit", mix(F.col("up")).alias("overweight"), mix(~F.col("up")).alias("underweight"), "equal_weight")


def strategies(sorted_: DataFrame, by: str = "strategy") -> DataFrame:
    """One row a strategy: spread and long-only performance, information ratio, mean turnover without the first quarter."""
    spread = performance(long_short(sorted_, by=[by]).select(by, "quarter", F.col("spread").alias("r")), [by])
    longs = long_only(sorted_, by=[by])
    top = performance(longs.select(by, "quarter", F.col("long").alias("r")), [by]).select(by, F.col("ann_return").alias("lo_ann_return"), F.col("sharpe").alias("lo_sharpe"))
    ir = information_ratio(longs.select(by, "active"), [by]).select(by, "ir")
    turns = turnover(sorted_.where("quintile = 5"), [by]).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("quarter")))
    mean_turnover = turns.where("k > 1").groupBy(by).agg(F.avg("turnover").alias("mean_turnover"))
    return spread.join(top, by, "left").join(ir, by, "left").join(mean_turnover, by, "left")


def long_enough(signals: DataFrame, by: str = "strategy", at_least: int = 20) -> DataFrame:
    """Rows with a score, of signals that have at least so many."""
    x = signals.where("score is not null")
    return x.join(x.groupBy(by).agg(F.count(F.lit(1)).alias("n__")).where(F.col("n__") >= at_least).select(by), by, "left_semi")
