"""Accuracy and inference on long predictions and on per-window differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import distributions as D
from panelloom.functions import order as O
from panelloom.functions import semantics as S


def r_squared(preds: DataFrame, by: list[str], pred: str = "pred", actual: str = "actual", denominator: str = "grand") -> DataFrame:
    """(*by, r2, mae, n): 1 - SSE/SST about the mean of all the group's actuals; 0 if they are all equal.

    ``denominator`` "actor": about each actor's own mean within the group instead.
    """
    rows = preds.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    about = [*by, *(["actor"] if denominator == "actor" else [])]
    n = F.count(F.lit(1))
    error = F.col(actual) - F.col(pred)
    # Central moments merge from partial ones, so no group has to meet in one place for its mean.
    d = rows.groupBy(*about).agg(F.sum(error**2).alias("sse__"), (F.var_pop(actual) * n).alias("sst__"), F.sum(F.abs(error)).alias("sae__"), n.alias("n__"))
    sse, sst = F.sum("sse__"), F.sum("sst__")
    return d.groupBy(*by).agg(F.when(sst > 0, 1 - sse / sst).otherwise(F.lit(0.0)).alias("r2"), (F.sum("sae__") / F.sum("n__")).alias("mae"), F.sum("n__").alias("n"))


def paired_t(deltas: DataFrame, by: list[str], delta: str = "delta", at_least: int = 3) -> DataFrame:
    """(*by, n, mean, t, p) of non-null differences; t and its two-sided p (n - 1 degrees) are null below ``at_least`` of them or without spread."""
    n, se = F.count(delta), F.stddev_samp(delta) / F.sqrt(F.count(delta))
    out = deltas.groupBy(*by).agg(n.alias("n"), F.avg(delta).alias("mean"), F.when((n >= at_least) & (se >= 1e-15), F.avg(delta) / se).alias("t"))
    return out.withColumn("p", D.t_two_sided(F.col("t"), F.col("n") - 1))


def dm_test(errors: DataFrame, by: list[str], first: str, second: str, horizon: int = 1) -> DataFrame:
    """(*by, dm, p, n): Diebold-Mariano on squared errors of two forecasts, with the small-sample correction of Harvey et al., and its two-sided p.

    0 and 1 where there are fewer than two rows or no variance; p is of Student's t with n - 1 degrees.
    """
    d = errors.withColumn("d__", F.col(first) ** 2 - F.col(second) ** 2)
    n, var = F.count("d__"), F.var_samp("d__")
    fix = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    return d.groupBy(*by).agg(F.when((n >= 2) & (var > 0), F.avg("d__") / F.sqrt(var / n) * fix).otherwise(F.lit(0.0)).alias("dm"), n.alias("n")).withColumn("p", F.coalesce(D.t_two_sided(F.col("dm"), F.col("n") - 1), F.lit(1.0)))


def dm_hac(deltas: DataFrame, by: list[str], order: str, delta: str = "delta", bandwidth: int = 1) -> DataFrame:
    """(*by, n, mean, t, p): mean over its Newey-West error with Bartlett weights, and the two-sided p of Student's t with n - 1 degrees.

    The zero-lag term is the sample variance (ddof 1); lag h averages products of deviations over n - h terms; the long-run
    variance is at least 1e-12.
    """
    group, seq = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    d = deltas.where(F.col(delta).isNotNull()).withColumn("e__", F.col(delta) - F.avg(delta).over(group))
    for h in range(1, bandwidth + 1):
        d = d.withColumn(f"g{h}__", F.col("e__") * F.lag("e__", h).over(seq))
    n = F.count(delta)
    lrv = F.var_samp(delta)
    for h in range(1, bandwidth + 1):
        lrv = lrv + 2 * (1 - h / (bandwidth + 1)) * F.coalesce(F.sum(f"g{h}__") / F.when(n > h, n - h), F.lit(0.0))
    out = d.groupBy(*by).agg(n.alias("n"), F.avg(delta).alias("mean"), F.when(n >= 2, F.avg(delta) / F.sqrt(F.greatest(lrv, F.lit(1e-12)) / n)).alias("t"))
    return out.withColumn("p", D.t_two_sided(F.col("t"), F.col("n") - 1))


def rank_ic(preds: DataFrame, by: list[str], pred: str = "pred", actual: str = "actual") -> DataFrame:
    """(*by, ic, n): Spearman correlation of forecast and outcome."""
    rows = preds.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    ranked = O.ranked(rows, {"a__": pred, "b__": actual}, by)
    return ranked.groupBy(*by).agg(F.corr("a__", "b__").alias("ic"), F.count(F.lit(1)).alias("n"))


def rank_stability(panel: DataFrame, least_common: int = 5) -> DataFrame:
    """(period, rho, n): Spearman correlation of each cross-section with the one before, on actors in both."""
    order = panel.select("period").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("period")))  # one row a period
    rows = panel.where("value is not null").join(order, "period")
    before = rows.select("actor", (F.col("k") + 1).alias("k"), F.col("value").alias("before"))
    both = O.ranked(rows.join(before, ["actor", "k"]), {"a__": "value", "b__": "before"}, "period")
    return both.groupBy("period").agg(F.corr("a__", "b__").alias("rho"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_common)


def deltas(scores: DataFrame, base: str, by: list[str], arch: str = "arch", score: str = "r2") -> DataFrame:
    """(*by, arch, delta): each architecture's score less the base's in the same window."""
    ref = scores.where(F.col(arch) == base).select(*by, F.col(score).alias("base__"))
    return scores.where(F.col(arch) != base).join(ref, by).select(*by, arch, (F.col(score) - F.col("base__")).alias("delta"))


def regimes(differences: DataFrame, spans: dict[str, tuple[int, int]], by: list[str], year: str = "test_year") -> DataFrame:
    """(*by, regime, mean, n, wins) over spans of years, both ends included; spans may overlap."""
    hits = F.array_compact(F.array(*(F.when(F.col(year).between(a, b), F.lit(name)) for name, (a, b) in spans.items())))
    return differences.withColumn("regime", F.explode(hits)).groupBy(*by, "regime").agg(F.avg("delta").alias("mean"), F.count("delta").alias("n"), F.count_if(F.col("delta") > 0).alias("wins"))


def sliding(differences: DataFrame, by: list[str], width: int = 3, year: str = "test_year") -> DataFrame:
    """(*by, first year, mean) of ``width`` successive years, full spans only."""
    frame = Window.partitionBy(*by).orderBy(year).rowsBetween(0, width - 1)
    return differences.withColumn("mean", S.rolling(F.avg, F.col("delta"), frame, width)).where("mean is not null").select(*by, year, "mean")


def leave_one_out_selection(differences: DataFrame, unit: str = "block", year: str = "test_year") -> DataFrame:
    """(held_out, unit, mean): units whose mean difference over all other years is above 0."""
    total = differences.groupBy(unit).agg(F.sum("delta").alias("sum__"), F.count("delta").alias("n__"))
    rest = differences.join(total, unit).where("n__ > 1").withColumn("mean", (F.col("sum__") - F.col("delta")) / (F.col("n__") - 1))
    return rest.where("mean > 0").select(F.col(year).alias("held_out"), unit, "mean")


def verdict(mean: Column, low: Column, least: float = 0.005) -> Column:
    """A win: the mean difference reaches ``least`` and its interval lies above 0."""
    return (mean >= least) & (low > 0)


def combination(errors: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """(*by, weight): the first forecast's weight that minimises the pair's error variance, within [0, 1].

    Fitted on the rows it is given: on test rows it is in-sample.
    """
    v1, v2, c = F.var_samp(first), F.var_samp(second), F.covar_samp(first, second)
    den = v1 + v2 - 2 * c
    return errors.groupBy(*by).agg(F.when(F.abs(den) > 1e-12, F.least(F.greatest((v2 - c) / den, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5)).alias("weight"))


def gap_ols(rows: DataFrame, y: str, x: str) -> DataFrame:
    """(n, beta, se, t, r2) of y on x with a constant."""
    n, sxx, sxy, syy = F.count(F.lit(1)), F.var_samp(x), F.covar_samp(x, y), F.var_samp(y)
    beta = F.try_divide(sxy, sxx)
    rss = (n - 1) * (syy - beta * sxy)
    se = F.sqrt(F.greatest(rss, F.lit(0.0)) / (n - 2) / ((n - 1) * sxx))
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return good.agg(n.alias("n"), beta.alias("beta"), se.alias("se"), F.try_divide(beta, se).alias("t"), (1 - F.try_divide(rss, (n - 1) * syy)).alias("r2"))


def gap_fixed_effects(rows: DataFrame, y: str, x: str, actor: str = "actor") -> DataFrame:
    """(n, n_actors, beta, se, t): within-actor slope with errors clustered by actor.

    The small-sample factor is G/(G-1) * (n-1)/(n-1-G), t has G-1 degrees of freedom.
    """
    own = Window.partitionBy(actor)
    w = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("x__", F.col(x) - F.avg(x).over(own)).withColumn("y__", F.col(y) - F.avg(y).over(own))
    beta = w.agg(F.try_divide(F.sum(F.col("x__") * F.col("y__")), F.sum(F.col("x__") ** 2)).alias("beta"), F.sum(F.col("x__") ** 2).alias("sxx"), F.count(F.lit(1)).alias("n"))
    scores = w.crossJoin(F.broadcast(beta)).groupBy(actor).agg((F.sum(F.col("x__") * (F.col("y__") - F.col("beta") * F.col("x__"))) ** 2).alias("s2"), F.first("beta").alias("beta"), F.first("sxx").alias("sxx"), F.first("n").alias("n"))
    g = F.count(F.lit(1))
    n = F.first("n")
    se = F.sqrt(F.sum("s2") * (g / (g - 1)) * ((n - 1) / (n - 1 - g))) / F.first("sxx")
    return scores.agg(n.alias("n"), g.alias("n_actors"), F.first("beta").alias("beta"), se.alias("se"), F.try_divide(F.first("beta"), se).alias("t"))
