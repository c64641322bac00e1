"""Studies over forecasts, signals and registries: variant grids, held-out selection, leak tests, perturbed targets, registries built in steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import distributions as D
from panelloom.functions import order as O
from panelloom.functions import semantics as S
from panelloom.operators.inference import PRIME, drawn
from panelloom.operators.portfolio import PERIODS, matched
from panelloom.session import written

EPS = 1e-8


def top_n_grid(signals: DataFrame, returns: DataFrame, by: list[str], sizes: list[int], sides: int = 2) -> DataFrame:
    """(*by, n, quarter, long, short, equal_weight): as portfolio.top_n for each size, from one sort of each variant's quarters.

    ``signals`` has a row a (*by, quarter, actor_id). Quarters with fewer than ``sides`` * n names are left out of that size.
    """
    cross = Window.partitionBy(*by, "quarter")
    x = matched(signals, returns).withColumn("names", F.count(F.lit(1)).over(cross))
    x = x.withColumn("hi", F.row_number().over(cross.orderBy(F.col("score").desc(), F.col("actor_id").desc()))).withColumn("lo", F.row_number().over(cross.orderBy("score", "actor_id")))

    def side(place: str, n: int) -> Column:
        return F.avg(F.when(F.col(place) <= n, F.col("return_q")))

    cells = [F.struct(F.lit(n).alias("n"), side("hi", n).alias("long"), side("lo", n).alias("short")) for n in sizes]
    g = x.groupBy(*by, "quarter").agg(F.first("names").alias("names"), F.avg("return_q").alias("equal_weight"), F.array(*cells).alias("cells"))
    out = g.select(*by, "quarter", "names", "equal_weight", F.inline("cells"))
    return out.where(F.col("names") >= sides * F.col("n")).select(*by, "n", "quarter", "long", "short", "equal_weight")


def sharpe(r: Column, more_than: int = 3) -> Column:
    """Aggregate: annual Sharpe ratio of more than so many quarters, else null; 0 without spread."""
    sd = F.stddev_samp(r)
    return F.when(F.count(r) > more_than, F.when(sd > 1e-15, F.avg(r) / sd * math.sqrt(PERIODS)).otherwise(F.lit(0.0)))


def volatility_scale(returns: DataFrame, width: int = 4, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(quarter, scale): the median of the market's trailing volatility over its own value, kept in bounds; null until ``width`` quarters are there."""
    market = returns.groupBy("quarter").agg(F.avg("return_q").alias("r"))
    w = Window.orderBy("quarter")  # one row a quarter
    vol = market.withColumn("v", S.rolling(F.stddev_samp, F.col("r"), w.rowsBetween(1 - width, 0), width))
    middle = vol.agg(F.median("v").alias("m"))  # one row
    return vol.crossJoin(F.broadcast(middle)).select("quarter", F.when(F.col("v").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") / (F.col("v") + EPS)))).alias("scale"))


def volatility_scaled(signal: DataFrame, returns: DataFrame) -> DataFrame:
    """Scores times their quarter's scale, 1 where it is unknown."""
    x = signal.join(volatility_scale(returns), "quarter", "left")
    return x.select("quarter", "actor_id", (F.col("score") * F.coalesce("scale", F.lit(1.0))).alias("score"))


def chosen_units(differences: DataFrame, until: int, wins: tuple[int, int], unit: str = "block", year: str = "test_year") -> DataFrame:
    """(unit, mean, wins, tier) of the units chosen on years up to ``until``.

    Tier 0: mean above 0 and at least wins[0] years above 0; tier 1: wins[1] years; tier 2: mean above 0. The first tier
    that holds any unit is taken.
    """
    g = differences.where(F.col(year) <= until).groupBy(unit).agg(F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("wins")).where("mean > 0")
    tier = F.when(F.col("wins") >= wins[0], 0).when(F.col("wins") >= wins[1], 1).otherwise(2)
    g = g.withColumn("tier", tier)
    return g.join(F.broadcast(g.agg(F.min("tier").alias("tier"))), "tier").select(unit, "mean", "wins", "tier")


def frozen_gain(preds: DataFrame, chosen: DataFrame, after: int, base: str, local: str, unit: str = "block", year: str = "year") -> DataFrame:
    """(year, base_r2, mixed_r2, delta): forecasts of the chosen units from ``local``, all others from ``base``, on years after ``after``."""
    mine = chosen.select(unit).withColumn("in__", F.lit(True))
    x = preds.where(F.col(year) > after).join(mine, unit, "left").withColumn("mix__", F.when(F.col("in__"), F.col(local)).otherwise(F.col(base)))
    miss = lambda p: F.sum((F.col("actual") - F.col(p)) ** 2)
    g = x.groupBy(year).agg(miss(base).alias("b"), miss("mix__").alias("m"), (F.var_pop("actual") * F.count("actual")).alias("t"))
    r2 = lambda c: F.when(F.col("t") > 0, 1 - F.col(c) / F.col("t"))
    return g.select(year, r2("b").alias("base_r2"), r2("m").alias("mixed_r2")).withColumn("delta", F.col("mixed_r2") - F.col("base_r2"))


def error_correlation(preds: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """(*by, n, corr) of two forecasts' squared errors."""
    sq = lambda p: (F.col("actual") - F.col(p)) ** 2
    return preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(sq(first), sq(second)).alias("corr"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs: null for fewer than three, 0 for a perfect one."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when((n > 2) & r.isNotNull(), F.when(F.abs(r) >= 1, 0.0).otherwise(D.t_two_sided(t, n - 2)))


def leak_test(preds: DataFrame, pred: str) -> DataFrame:
    """(against, n, r, p): correlation of a forecast with the same quarter's value and with the one before; two-sided p of Student's t with n - 2 degrees."""
    before = F.lag("actual").over(Window.partitionBy("actor_id").orderBy("quarter"))
    x = preds.withColumn("before__", before)
    pairs = x.select(F.col(pred).alias("x"), F.inline(F.array(F.struct(F.lit("same").alias("against"), F.col("actual").alias("y")), F.struct(F.lit("lagged").alias("against"), F.col("before__").alias("y")))))
    g = pairs.where("x is not null and y is not null").groupBy("against").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    return g.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def perturbed(panel: DataFrame, sigmas: list[float], key: str = "actor", period: str = "period", value: str = "value") -> DataFrame:
    """(sigma, key, period, value, noisy): normal noise on every value, kept in [0, 1]; sigma 0 leaves values alone.

    Noise comes from whole-number arithmetic on (key, quarter), so that any engine and any order of rows gives the same.
    """
    place = F.year(period) * 4 + F.quarter(period)
    u = (drawn(F.col(key), place, F.lit(PRIME - 1)) + 1) / F.lit(float(PRIME))
    v = drawn(F.col(key) + 1_000_003, place, F.lit(PRIME - 1)) / F.lit(float(PRIME))
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
    x = panel.where(F.col(value).isNotNull()).withColumn("z__", normal).withColumn("sigma", F.explode(F.array(*map(F.lit, sigmas))))
    noisy = F.when(F.col("sigma") == 0, F.col(value)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) + F.col("sigma") * F.col("z__"))))
    return x.select("sigma", key, period, value, noisy.alias("noisy"))


def years_seen(rows: DataFrame, date: str, unit: str, *more: str) -> DataFrame:
    """(year, n_units, n_pairs): distinct units, and distinct combinations with the other columns."""
    return rows.groupBy(F.year(date).alias("year")).agg(F.count_distinct(unit).alias("n_units"), F.count_distinct(unit, *more).alias("n_pairs"))


def labelled_flows(coefs: DataFrame, labels: DataFrame, since: int, lag_days: int = 548) -> DataFrame:
    """Coefficients (text columns source, target, coefficient, year) cast, from year ``since`` on, with sectors of both ends and date of publication.

    Rows with a sector at neither end go, as do those whose figures don't parse. ``labels``: (code, sector), one row a code.
    """
    x = coefs.withColumn("year", F.col("year").try_cast("int")).withColumn("coefficient", F.regexp_replace("coefficient", ",", "").try_cast("double"))
    x = x.where((F.col("year") >= since) & F.col("coefficient").isNotNull())
    for end in ("source", "target"):
        x = x.join(labels.select(F.col("code").alias(end), F.col("sector").alias(f"{end}_sector")), end, "left")
    x = x.where("source_sector is not null or target_sector is not null")
    return x.select("source", "source_sector", "target", "target_sector", "coefficient", "year", F.date_add(F.make_date("year", F.lit(12), F.lit(31)), lag_days).alias("pub_date"))


def listed_actors(firms: DataFrame, dropped: DataFrame, ids: DataFrame, key: str = "actor", sector: str = "sector", position: str = "position") -> DataFrame:
    """Firms that weren't dropped, with their running place in the sector (from 0, in order of ``position``) and an outside id where one is known."""
    w = Window.partitionBy(sector).orderBy(position)
    kept = firms.join(dropped.select(key).distinct(), key, "left_anti").withColumn(sector, F.coalesce(sector, F.lit("Unknown")))
    return kept.withColumn("sector_rank", F.row_number().over(w) - 1).join(ids, key, "left")


def expanded(base: DataFrame, candidates: DataFrame, coverage: DataFrame, sizes: dict[str, int], group: str = "sector", key: str = "actor") -> DataFrame:
    """(key, part): ``base``, then of each group in ``sizes`` its first by coverage (ties by key), those in the base already skipped without replacement.

    Coverage that is missing counts as 0.
    """
    x = candidates.where(F.col(group).isin(*sizes)).join(coverage, key, "left")
    w = Window.partitionBy(group).orderBy(F.coalesce("coverage", F.lit(0)).desc(), key)
    most = F.element_at(F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair]), F.col(group))
    top = x.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= most)
    added = top.join(base.select(key), key, "left_anti").select(key, F.col(group).alias("part"))
    return base.select(key, F.lit("base").alias("part")).unionByName(added)


def group_numbers(rows: DataFrame, group: str = "sector", missing: str = "unknown") -> DataFrame:
    """``rows`` with ``index`` (place of their group's name in order, from 0) and ``n_groups``: a one-hot code in sparse form."""
    x = rows.withColumn(group, F.coalesce(group, F.lit(missing)))
    names = x.select(group).distinct()
    all_ = Window.partitionBy(F.lit(1))  # one row a group
    numbers = names.withColumn("index", F.row_number().over(all_.orderBy(group)) - 1).withColumn("n_groups", F.count(F.lit(1)).over(all_))
    return x.join(numbers, group)


def timed_signals(preds: DataFrame, returns: DataFrame) -> DataFrame:
    """(variant, quarter, actor_id, score) of every timing at once: what is known ``k`` quarters late, and signals that must or must not work.

    local is pred_m2 - pred_g1, change pred_m2 less the last value, level pred_m2; each by lag, as it is (high) or with its sign turned (low).
    same_return and next_return look ahead and must score high; random is drawn from whole-number arithmetic on (actor_id, quarter) and must not.
    All lags of a table are read off one sort by actor.
    """
    own = Window.partitionBy("actor_id").orderBy("quarter")
    base = preds.withColumn("local", F.col("pred_m2") - F.col("pred_g1")).withColumn("change", F.col("pred_m2") - F.lag("actual").over(own)).withColumn("level", F.col("pred_m2"))
    of = lambda name, score: F.struct(F.lit(name).alias("variant"), score.alias("score"))
    lags = {"local": (4, 3), "change": (4, 3), "level": (3, 3)}
    at = lambda c, k: F.lag(c, k).over(own) if k else F.col(c)
    cells = [of(f"{c}_{side}_lag{k}", sign * at(c, k)) for c, many in lags.items() for side, sign, n in zip(("high", "low"), (1, -1), many) for k in range(n)]
    place = F.year("quarter") * 4 + F.quarter("quarter")
    controls = [of("same_return", F.col("return_q")), of("next_return", F.lead("return_q").over(own)), of("random", drawn(F.col("actor_id"), place, F.lit(PRIME - 1)).cast("double"))]
    rows = [t.select("quarter", "actor_id", F.array(*of_t).alias("of")) for t, of_t in ((base, cells), (returns, controls))]
    return rows[0].unionByName(rows[1]).select("quarter", "actor_id", F.inline("of")).where("score is not null").select("variant", "quarter", "actor_id", "score")


def timing_variants(preds: DataFrame, returns: DataFrame, fraction: float = 0.33, least: int = 3, names: int = 4, quarters: int = 4) -> DataFrame:
    """(variant, n, sharpe, ir, t, p, hit_rate): each timing's best ``fraction`` of a quarter's names against all of them.

    At least ``least`` names are held; quarters of fewer than ``names`` and variants of fewer than ``quarters`` quarters are left out.
    Ties go to the greater actor_id. Cross-sections are ranked in ranges, so that no task sorts a whole quarter.
    """
    by = ["variant", "quarter"]
    x = written(timed_signals(preds, returns).join(returns.select("quarter", "actor_id", "return_q"), ["quarter", "actor_id"]).where("return_q is not null"))
    size = x.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= names)
    x = O.ranked(x.withColumn("at", F.struct("score", "actor_id")), {"place": "at"}, by).join(size, by)
    held = F.col("place") > F.col("size") - F.greatest(F.lit(least), F.floor(F.col("size") * F.lit(fraction)))
    q = x.groupBy(*by).agg(F.avg(F.when(held, F.col("return_q"))).alias("r"), F.avg("return_q").alias("equal_weight")).withColumn("active", F.col("r") - F.col("equal_weight"))
    sd, n, rsd = F.stddev_samp("active"), F.count(F.lit(1)), F.stddev_samp("r")
    annual = F.sqrt(F.lit(float(PERIODS)))
    out = q.groupBy("variant").agg(
        n.alias("n"), F.when(rsd > 1e-15, F.avg("r") / rsd * annual).otherwise(F.lit(0.0)).alias("sharpe"), F.when(sd > 1e-15, F.avg("active") / sd * annual).otherwise(F.lit(0.0)).alias("ir"),
        F.when(sd > 1e-15, F.avg("active") / (sd / F.sqrt(n))).alias("t"), F.avg(F.when(F.col("active") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    ).where(F.col("n") >= quarters)
    return out.select("variant", "n", "sharpe", "ir", "t", D.t_two_sided(F.col("t"), F.col("n") - 1).alias("p"), "hit_rate")


def timing_correlations(preds: DataFrame, returns: DataFrame, first: int = -2, last: int = 4, least: int = 10) -> DataFrame:
    """(lag, n, r, p): correlation of pred_m2 - pred_g1 ``lag`` quarters late (negative: early, which leaks) with the quarter's return."""
    own = Window.partitionBy("actor_id").orderBy("quarter")
    both = preds.join(returns.select("quarter", "actor_id", "return_q"), ["quarter", "actor_id"]).withColumn("local", F.col("pred_m2") - F.col("pred_g1"))
    cells = F.array(*(F.struct(F.lit(k).alias("lag"), F.lag("local", k).over(own).alias("x")) for k in range(first, last + 1)))
    x = both.select("return_q", cells.alias("of")).select("return_q", F.inline("of")).where("x is not null and return_q is not null")
    g = x.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "return_q").alias("r")).where(F.col("n") >= least)
    return g.withColumn("p", correlation_p(F.col("r"), F.col("n")))
