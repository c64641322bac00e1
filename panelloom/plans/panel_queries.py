"""Panel, normalisation, autoregression and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators import autoregression as ar
from panelloom.operators import normalise as N
from panelloom.operators import scoring as sc
from panelloom.operators import windows as W
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.standins import sql

BOOK = Book()
page = BOOK.page


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to six places: sums aren't associative, so the last bits differ between engines."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- panel and normalisation -----------------------------------------------------------------------------------


@page(sql("SELECT actor, period, round(value, 6) AS value FROM panel", "panel"), dates="period")
def panel_quarter_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.panel(spark, d), "value")


_PCT = "CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY period ORDER BY value NULLS LAST) + (count(value) OVER (PARTITION BY period, value) - 1) / 2) / count(value) OVER (PARTITION BY period) END"


@page(sql(f"SELECT actor, period, round({_PCT}, 6) AS rank FROM gappy", "gappy"), dates="period")
def xs_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.cross_section_rank(st.gappy(spark, d)).select("actor", "period", "rank"), "rank")


@page(sql("SELECT actor, period, round(CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS scaled FROM gappy WINDOW w AS (PARTITION BY period)", "gappy"), dates="period")
def xs_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.cross_section_minmax(st.gappy(spark, d)).select("actor", "period", "scaled"), "scaled")


@page(sql("SELECT actor, period, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS scaled FROM gappy WINDOW w AS (PARTITION BY actor)", "gappy"), dates="period")
def ts_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.time_series_minmax(st.gappy(spark, d)).select("actor", "period", "scaled"), "scaled")


@page(sql("SELECT actor, period, round(CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER w - min(value) OVER w > 1e-10 THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS scaled FROM gappy WINDOW w AS (PARTITION BY actor ORDER BY period ROWS UNBOUNDED PRECEDING)", "gappy"), dates="period")
def recursive_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.recursive_minmax(st.gappy(spark, d)).select("actor", "period", "scaled"), "scaled")


@page(sql("SELECT actor, period, round(1 / (1 + exp(-(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0))), 6) AS squashed FROM gappy WINDOW w AS (PARTITION BY actor)", "gappy"), dates="period")
def zscore_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.zscore_sigmoid(st.gappy(spark, d)).select("actor", "period", "squashed"), "squashed")


@page(sql(f"SELECT actor, period, round(CASE WHEN value IS NULL THEN NULL WHEN coalesce(stddev_samp(r) OVER w, 0) <> 0 THEN r WHEN coalesce(stddev_samp(value) OVER w, 0) <> 0 THEN 1 / (1 + exp(-(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0))) ELSE 0.5 END, 6) AS intensity FROM ranked WINDOW w AS (PARTITION BY actor)", "gappy", ranked=f"SELECT *, {_PCT} AS r FROM gappy"), dates="period")
def equity_intensity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.rank_or_fallback(st.gappy(spark, d)).select("actor", "period", "intensity"), "intensity")


@page(sql("SELECT actor, period, round(CASE WHEN b <> 0 THEN value / b - 1 END, 6) AS growth FROM (SELECT *, lag(value, 4) OVER (PARTITION BY actor ORDER BY period) AS b FROM gappy)", "gappy"), dates="period")
def yoy_growth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.growth(st.gappy(spark, d), 4).select("actor", "period", "growth"), "growth")


_GRID = "SELECT a.actor, p.period, g.value FROM (SELECT DISTINCT actor FROM gappy) a CROSS JOIN (SELECT DISTINCT period FROM gappy) p LEFT JOIN gappy g USING (actor, period)"


@page(sql("SELECT actor, period, round(last_value(value IGNORE NULLS) OVER (PARTITION BY actor ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS filled FROM grid_", "gappy", grid_=_GRID), dates="period")
def ffill_limit1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.forward_fill(st.gappy(spark, d), 1).select("actor", "period", "filled"), "filled")


@page(sql("SELECT actor, period, round(last_value(value IGNORE NULLS) OVER (PARTITION BY actor ORDER BY period ROWS UNBOUNDED PRECEDING) - first_value(value IGNORE NULLS) OVER (PARTITION BY actor ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS change FROM grid_", "gappy", grid_=_GRID), dates="period")
def cumulative_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.cumulative_change(st.gappy(spark, d)).select("actor", "period", "change"), "change")


_FLOWS = "SELECT l_suppkey AS actor, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS top, round(sum(CASE WHEN l_linestatus = 'O' OR l_quantity > 10 THEN l_extendedprice END), 2) AS bottom FROM lineitem GROUP BY 1, 2"


def _flows(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("actor"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("period")).agg(
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 2).alias("top"),
        F.round(F.sum(F.when((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 10), F.col("l_extendedprice"))), 2).alias("bottom"),
    )


@page(sql(f"SELECT actor, period, round(rank, 6) AS rank FROM (SELECT actor, period, {_PCT} AS rank FROM x) WHERE actor IN (SELECT actor FROM x GROUP BY 1 HAVING count(value) > 0.5 * (SELECT count(DISTINCT period) FROM x))", flows=_FLOWS, x="SELECT actor, period, top / nullif(bottom, 0) AS value FROM flows WHERE top IS NOT NULL AND bottom IS NOT NULL"), dates="period")
def ratio_panel(spark: SparkSession, d: str) -> DataFrame:
    f = _flows(spark, d)
    part = lambda c: f.where(F.col(c).isNotNull()).select("actor", "period", F.col(c).alias("value"))
    return rounded(N.ratio_panel(part("top"), part("bottom")), "rank")


@page(sql("SELECT actor, period, round(CASE WHEN bottom > 0 AND top IS NOT NULL THEN greatest(top / bottom, 0) END, 6) AS ratio, round(CASE WHEN bottom > 0 AND top IS NOT NULL THEN least(abs(top) / bottom, 1) END, 6) AS ratio_signed FROM flows", flows=_FLOWS), dates="period")
def capex_ratio(spark: SparkSession, d: str) -> DataFrame:
    f = _flows(spark, d).withColumnsRenamed({"top": "capex", "bottom": "assets"})
    both = N.capex_ratio(N.capex_ratio(f, signed=True).withColumnRenamed("ratio", "ratio_signed"))
    return rounded(both.select("actor", "period", "ratio", "ratio_signed"), "ratio", "ratio_signed")


@page(sql("SELECT actor, period, round(CASE WHEN layer = 2 THEN lag(value) OVER (PARTITION BY actor ORDER BY period) ELSE value END, 6) AS lagged FROM panel JOIN registry USING (actor)", "panel", "registry"), dates="period")
def filing_lag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.firm_lag(st.panel(spark, d), st.registry(spark, d)).select("actor", "period", "lagged"), "lagged")


_TARGETS = {
    "winsorized_z": "greatest(least((value - avg(value) OVER (PARTITION BY period)) / nullif(stddev_samp(value) OVER (PARTITION BY period), 0), 2), -2)",
    "sector_relative": "value - avg(value) OVER (PARTITION BY period, sector)",
    "ma2": "avg(value) OVER (PARTITION BY actor ORDER BY period ROWS 1 PRECEDING)",
    "ma4": "avg(value) OVER (PARTITION BY actor ORDER BY period ROWS 3 PRECEDING)",
    "changes": "value - lag(value) OVER (PARTITION BY actor ORDER BY period)",
    "high_frequency": "value - avg(value) OVER (PARTITION BY actor ORDER BY period ROWS 3 PRECEDING)",
    "ranks": _PCT,
}
for _name, _expr in _TARGETS.items():
    BOOK.add(
        f"target_{_name}",
        lambda spark, d, n=_name: rounded(N.transformed(st.gappy(spark, d).join(st.registry(spark, d).select("actor", "sector"), "actor"), n).select("actor", "period", "target"), "target"),
        sql(f"SELECT actor, period, round({_expr}, 6) AS target FROM gappy JOIN registry USING (actor)", "gappy", "registry"),
        "period",
    )


def _quantile_sql(p: str) -> str:
    """The standard normal's quantile of ``p``, as operators.normalise.normal_quantile has it."""

    def poly(x: str, terms: tuple[float, ...]) -> str:
        out = repr(terms[0]) + "::DOUBLE"
        for t in terms[1:]:
            out = f"({out} * {x} + ({t!r}::DOUBLE))"
        return out

    ratio = lambda x, top, bottom: f"{poly(x, top)} / {poly(x, (*bottom, 1.0))}"
    tail = lambda u: ratio(f"sqrt(-2 * ln({u}))", *N.NORMAL_TAIL)
    q = f"(({p}) - 0.5)"
    top, bottom = N.NORMAL_MIDDLE
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 1 - 0.02425 THEN -{tail(f'(1 - {p})')} ELSE {poly(f'({q} * {q})', top)} * {q} / {poly(f'({q} * {q})', (*bottom, 1.0))} END"


@page(sql(f"SELECT actor, period, round({_quantile_sql('p')}, 6) AS target FROM x", "gappy", "registry", x=f"SELECT actor, period, CASE WHEN value IS NOT NULL THEN greatest(least({_PCT}, 0.995), 0.005) END AS p FROM gappy JOIN registry USING (actor)"), dates="period")
def target_normal_quantiles(spark: SparkSession, d: str) -> DataFrame:
    p = st.gappy(spark, d).join(st.registry(spark, d).select("actor", "sector"), "actor")
    return rounded(N.transformed(p, "normal_quantiles").select("actor", "period", "target"), "target")


# --- windows and autoregression ----------------------------------------------------------------------------------


@page(sql("SELECT test_year, actor, period, round(value, 6) AS value, train FROM dealt", "dealt"), dates="period")
def estimation_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.dealt(spark, d).select("test_year", "actor", "period", "value", "train"), "value")


def _rho(name: str, cte: str, by: list[str]) -> None:
    BOOK.add(
        name,
        lambda spark, d: rounded(ar.rho(st.dealt_in_blocks(spark, d), by), "rho"),
        sql(f"SELECT test_year, {''.join(b + ', ' for b in by)}round(rho, 6) AS rho, n FROM {cte}", cte),
    )


_rho("pooled_ar1", "rho0", [])
_rho("layer_ar1", "rho1", ["layer"])
_rho("block_ar1", "rho2", ["block"])
_rho("actor_ar1_ols", "rho3", ["actor"])


@page(sql("SELECT test_year, actor, round(CASE WHEN stddev_pop(value) > 1e-10 AND stddev_pop(b) > 1e-10 THEN corr(b, value) ELSE 0 END, 6) AS rho FROM x WHERE b IS NOT NULL GROUP BY 1, 2", "dealt", x="SELECT *, lag(value) OVER (PARTITION BY test_year, actor ORDER BY period) AS b FROM dealt WHERE train"))
def actor_ar1_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ar.rho_correlation(st.dealt(spark, d)), "rho")


@page(sql("SELECT test_year, block, round(any_value(rho), 6) AS rho, round(CASE WHEN count(*) > 2 AND sum(prev * prev) > 1e-12 THEN sqrt(sum(pow(dev - rho * prev, 2)) / ((count(*) - 2) * sum(prev * prev))) END, 6) AS se FROM dev JOIN (SELECT test_year, block, rho FROM rho2) USING (test_year, block) WHERE train AND prev IS NOT NULL GROUP BY 1, 2", "rho2"))
def se_rho_block(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ar.rho_error(st.dealt_in_blocks(spark, d), ["block"]), "rho", "se")


@page(sql("SELECT test_year, actor, round(sum(w * value) / sum(w), 6) AS ewm FROM x GROUP BY 1, 2", "dealt", x="SELECT *, pow(0.5, (row_number() OVER (PARTITION BY test_year, actor ORDER BY period DESC) - 1) / 12) AS w FROM dealt WHERE train"))
def ewm_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ar.ewm_mean(st.dealt(spark, d)), "ewm")


@page(sql("SELECT year, quarter, actor_id, sector, round(actual, 6) AS actual, round(pred_g0, 6) AS pred_g0, round(pred_g1, 6) AS pred_g1, round(pred_m2, 6) AS pred_m2, round(pred_ar1, 6) AS pred_ar1 FROM preds", "preds"), dates="quarter")
def ar_predictions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.predictions(spark, d), "actual", "pred_g0", "pred_g1", "pred_m2", "pred_ar1")


# --- scoring and inference -----------------------------------------------------------------------------------------

_MODELS = ("g0", "g1", "m2", "ar1")
_LONG = "SELECT year AS test_year, quarter, actor_id AS actor, CASE WHEN sector IN ('AMERICA', 'ASIA', 'EUROPE') THEN sector ELSE 'REMAINDER' END AS block, actual, unnest(['g0', 'g1', 'm2', 'ar1']) AS arch, unnest([pred_g0, pred_g1, pred_m2, pred_ar1]) AS pred FROM preds"


def long_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = st.predictions(spark, d)
    block = F.when(F.col("sector").isin("AMERICA", "ASIA", "EUROPE"), F.col("sector")).otherwise(F.lit("REMAINDER"))
    base = p.select(F.col("year").alias("test_year"), "quarter", F.col("actor_id").alias("actor"), block.alias("block"), "actual", *(f"pred_{m}" for m in _MODELS))
    out = base.unpivot(["test_year", "quarter", "actor", "block", "actual"], [f"pred_{m}" for m in _MODELS], "arch", "pred")
    return out.withColumn("arch", F.regexp_replace("arch", "^pred_", ""))


def _r2(keys: str) -> str:
    return f"SELECT {keys}, CASE WHEN sum(pow(actual - m, 2)) > 0 THEN 1 - sum(pow(actual - pred, 2)) / sum(pow(actual - m, 2)) ELSE 0 END AS r2, avg(abs(actual - pred)) AS mae, count(*) AS n FROM (SELECT *, avg(actual) OVER (PARTITION BY {keys}) AS m FROM long_) GROUP BY {keys}"


@page(sql("SELECT test_year, arch, round(r2, 6) AS r2, round(mae, 6) AS mae, n FROM x", "preds", long_=_LONG, x=_r2("test_year, arch")))
def oos_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.r_squared(long_predictions(spark, d), ["test_year", "arch"]), "r2", "mae")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Panel -> windows -> four forecasts -> accuracy of each by block and year."""
    return rounded(sc.r_squared(long_predictions(spark, d), ["test_year", "arch", "block"]), "r2", "mae")


BOOK.add("oos_r2_by_block", flagship, sql("SELECT test_year, arch, block, round(r2, 6) AS r2, round(mae, 6) AS mae, n FROM x", "preds", long_=_LONG, x=_r2("test_year, arch, block")))

_DELTA = "SELECT test_year, block, arch, x.r2 - b.r2 AS delta FROM x JOIN (SELECT test_year, block, r2 FROM x WHERE arch = 'g0') b USING (test_year, block) WHERE arch <> 'g0'"
_DELTA_PARTS = {"long_": _LONG, "x": _r2("test_year, arch, block"), "delta_": _DELTA}


def block_deltas(spark: SparkSession, d: str) -> DataFrame:
    scores = sc.r_squared(long_predictions(spark, d), ["test_year", "arch", "block"])
    return sc.deltas(scores, "g0", ["test_year", "block"])


@page(sql("SELECT test_year, block, arch, round(delta, 6) AS delta FROM delta_", "preds", **_DELTA_PARTS))
def r2_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(block_deltas(spark, d), "delta")


def t_p(t: str, df: str, steps: int = 4000) -> str:
    """SQL of P(|T| > |t|): Simpson's rule on the density in the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    weight = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"sum({weight} * pow(greatest(cos({angle} + (pi() / 2 - {angle}) * k / {steps}.0), 0), {df} - 1)) * (pi() / 2 - {angle}) / {3 * steps}"
    return f"(SELECT 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {area} FROM range(0, {steps + 1}) AS g(k))"


_T = "SELECT arch, count(delta) AS n, avg(delta) AS mean, CASE WHEN count(delta) >= 3 AND stddev_samp(delta) / sqrt(count(delta)) >= 1e-15 THEN avg(delta) / (stddev_samp(delta) / sqrt(count(delta))) END AS t FROM delta_ GROUP BY 1"


@page(sql(f"SELECT arch, n, round(mean, 6) AS mean, round(t, 4) AS t, CASE WHEN t IS NOT NULL THEN round({t_p('t', '(n - 1)')}, 6) END AS p FROM t_", "preds", **_DELTA_PARTS, t_=_T))
def paired_t_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(sc.paired_t(block_deltas(spark, d), ["arch"]), "mean", "p"), "t", digits=4)


_DM = "SELECT test_year, CASE WHEN count(*) >= 2 AND var_samp(e) > 0 THEN avg(e) / sqrt(var_samp(e) / count(*)) * sqrt((count(*) + 1 - 2) / count(*)) ELSE 0 END AS dm, count(*) AS n FROM x GROUP BY 1"


@page(sql(f"SELECT test_year, round(dm, 4) AS dm, round({t_p('dm', '(n - 1)')}, 6) AS p, n FROM ({_DM})", "preds", x="SELECT year AS test_year, pow(actual - pred_g0, 2) - pow(actual - pred_m2, 2) AS e FROM preds"))
def dm_stat(spark: SparkSession, d: str) -> DataFrame:
    e = st.predictions(spark, d).select(F.col("year").alias("test_year"), (F.col("actual") - F.col("pred_g0")).alias("a"), (F.col("actual") - F.col("pred_m2")).alias("b"))
    return rounded(rounded(sc.dm_test(e, ["test_year"], "a", "b"), "p"), "dm", digits=4)


def _hac(bandwidth: int) -> str:
    terms = "".join(f" + 2 * {1 - h / (bandwidth + 1)} * coalesce(sum(e * l{h}) / nullif(count(*) - {h}, 0), 0)" for h in range(1, bandwidth + 1))
    lags = ", ".join(f"lag(e, {h}) OVER (PARTITION BY block ORDER BY quarter) AS l{h}" for h in range(1, bandwidth + 1))
    return sql(
        f"SELECT block, n, round(mean, 6) AS mean, round(t, 4) AS t, round({t_p('t', '(n - 1)')}, 6) AS p FROM (SELECT block, count(*) AS n, avg(dd) AS mean, avg(dd) / sqrt(greatest(var_samp(dd){terms}, 1e-12) / count(*)) AS t FROM y GROUP BY 1)", "preds",
        q="SELECT CASE WHEN sector IN ('AMERICA', 'ASIA', 'EUROPE') THEN sector ELSE 'REMAINDER' END AS block, quarter, round(100 * avg(pow(actual - pred_g0, 2) - pow(actual - pred_m2, 2)), 9) AS dd FROM preds GROUP BY 1, 2",
        x="SELECT *, dd - avg(dd) OVER (PARTITION BY block) AS e FROM q", y=f"SELECT *, {lags} FROM x",
    )


for _bw in (1, 2):
    BOOK.add(f"dm_hac_stat_bw{_bw}", lambda spark, d, bw=_bw: rounded(rounded(sc.dm_hac(_quarterly_gain(spark, d), ["block"], "quarter", "dd", bw), "mean", "p"), "t", digits=4), _hac(_bw))


def _quarterly_gain(spark: SparkSession, d: str) -> DataFrame:
    block = F.when(F.col("sector").isin("AMERICA", "ASIA", "EUROPE"), F.col("sector")).otherwise(F.lit("REMAINDER"))
    gain = (F.col("actual") - F.col("pred_g0")) ** 2 - (F.col("actual") - F.col("pred_m2")) ** 2
    return st.predictions(spark, d).groupBy(block.alias("block"), "quarter").agg(F.round(100 * F.avg(gain), 9).alias("dd"))


@page(sql("SELECT arch, quarter, round(corr(a, b), 6) AS ic, count(*) AS n FROM x GROUP BY 1, 2", "preds", long_=_LONG, x="SELECT *, rank() OVER (PARTITION BY arch, quarter ORDER BY pred) + (count(*) OVER (PARTITION BY arch, quarter, pred) - 1) / 2 AS a, rank() OVER (PARTITION BY arch, quarter ORDER BY actual) + (count(*) OVER (PARTITION BY arch, quarter, actual) - 1) / 2 AS b FROM long_"), dates="quarter")
def rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.rank_ic(long_predictions(spark, d), ["arch", "quarter"]), "ic")


@page(sql("SELECT period, round(corr(a, b), 6) AS rho, count(*) AS n FROM z GROUP BY 1 HAVING count(*) >= 5", "gappy", k="SELECT period, dense_rank() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM gappy)", y="SELECT g.actor, g.period, k.k, g.value FROM gappy g JOIN k USING (period) WHERE value IS NOT NULL", z="SELECT n.period, rank() OVER (PARTITION BY n.period ORDER BY n.value) + (count(*) OVER (PARTITION BY n.period, n.value) - 1) / 2 AS a, rank() OVER (PARTITION BY n.period ORDER BY o.value) + (count(*) OVER (PARTITION BY n.period, o.value) - 1) / 2 AS b FROM y n JOIN y o ON o.actor = n.actor AND o.k = n.k - 1"), dates="period")
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.rank_stability(st.gappy(spark, d)), "rho")


_SPANS = {"early": (1998, 1999), "late": (2000, 2001), "middle": (1999, 2000)}


@page(sql("SELECT arch, regime, round(avg(delta), 6) AS mean, count(delta) AS n, count(*) FILTER (delta > 0) AS wins FROM delta_ JOIN (VALUES ('early', 1998, 1999), ('late', 2000, 2001), ('middle', 1999, 2000)) AS s(regime, a, b) ON test_year BETWEEN a AND b GROUP BY 1, 2", "preds", **_DELTA_PARTS))
def regime_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.regimes(block_deltas(spark, d), _SPANS, ["arch"]), "mean")


@page(sql("SELECT arch, block, test_year, round(mean, 6) AS mean FROM (SELECT arch, block, test_year, avg(delta) OVER w AS mean, count(delta) OVER w AS n FROM delta_ WINDOW w AS (PARTITION BY arch, block ORDER BY test_year ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n >= 3", "preds", **_DELTA_PARTS))
def sliding3_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.sliding(block_deltas(spark, d), ["arch", "block"]), "mean")


@page(sql("SELECT a.test_year AS held_out, a.block, round(avg(b.delta), 6) AS mean FROM delta_ a JOIN delta_ b ON a.block = b.block AND a.test_year <> b.test_year AND a.arch = 'm2' AND b.arch = 'm2' GROUP BY 1, 2 HAVING avg(b.delta) > 0", "preds", **_DELTA_PARTS))
def lowo_selection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.leave_one_out_selection(block_deltas(spark, d).where("arch = 'm2'")), "mean")


@page(sql("SELECT test_year, round(CASE WHEN abs(v1 + v2 - 2 * c) > 1e-12 THEN least(greatest((v2 - c) / (v1 + v2 - 2 * c), 0), 1) ELSE 0.5 END, 4) AS weight FROM x", "preds", x="SELECT year AS test_year, var_samp(actual - pred_ar1) AS v1, var_samp(actual - pred_g0) AS v2, covar_samp(actual - pred_ar1, actual - pred_g0) AS c FROM preds GROUP BY 1"))
def forecast_combination(spark: SparkSession, d: str) -> DataFrame:
    e = st.predictions(spark, d).select(F.col("year").alias("test_year"), (F.col("actual") - F.col("pred_ar1")).alias("a"), (F.col("actual") - F.col("pred_g0")).alias("b"))
    return rounded(sc.combination(e, ["test_year"], "a", "b"), "weight", digits=4)


_GAP = "SELECT actor, period, value, lead(value, 4) OVER (PARTITION BY actor ORDER BY period) - value AS y, value - avg(value) OVER (PARTITION BY period) AS x FROM panel"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    later = F.lead("value", 4).over(Window.partitionBy("actor").orderBy("period"))
    return st.panel(spark, d).withColumn("y", later - F.col("value")).withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy("period")))


@page(sql("SELECT count(*) AS n, round(regr_slope(y, x), 6) AS beta, round(sqrt((count(*) - 1) * (var_samp(y) - regr_slope(y, x) * covar_samp(x, y)) / (count(*) - 2) / ((count(*) - 1) * var_samp(x))), 6) AS se, round(regr_r2(y, x), 6) AS r2 FROM g WHERE x IS NOT NULL AND y IS NOT NULL", "panel", g=_GAP))
def gap_ols(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.gap_ols(_gaps(spark, d), "y", "x").drop("t"), "beta", "se", "r2")


@page(
    sql(
        "SELECT any_value(n) AS n, count(*) AS n_actors, round(any_value(beta), 6) AS beta, round(sqrt(sum(s * s) * (count(*) / (count(*) - 1)) * ((any_value(n) - 1) / (any_value(n) - 1 - count(*)))) / any_value(sxx), 6) AS se FROM c", "panel",
        g=_GAP, w="SELECT actor, x - avg(x) OVER (PARTITION BY actor) AS x, y - avg(y) OVER (PARTITION BY actor) AS y FROM g WHERE x IS NOT NULL AND y IS NOT NULL",
        b="SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, count(*) AS n FROM w", c="SELECT actor, sum(x * (y - beta * x)) AS s, any_value(beta) AS beta, any_value(sxx) AS sxx, any_value(n) AS n FROM w, b GROUP BY 1",
    )
)
def gap_fe_clustered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.gap_fixed_effects(_gaps(spark, d), "y", "x").drop("t"), "beta", "se")


@page(sql("SELECT a.actor, a.period, round(arg_max(b.value, b.period), 6) AS future FROM gappy a JOIN gappy b ON a.actor = b.actor AND b.value IS NOT NULL AND abs((year(b.period) - year(a.period)) * 12 + month(b.period) - month(a.period) - 12) <= 2 GROUP BY 1, 2", "gappy"), dates="period")
def interval_join_future(spark: SparkSession, d: str) -> DataFrame:
    """The last value within two months of a year ahead: an equi-join on the few months that qualify, not a range join."""
    g = st.gappy(spark, d)
    month = F.year("period") * 12 + F.month("period")
    a = g.select("actor", "period", F.explode(F.sequence(month + 10, month + 14)).alias("m"))
    b = g.where("value is not null").select("actor", month.alias("m"), F.col("period").alias("at"), "value")
    return rounded(a.join(b, ["actor", "m"]).groupBy("actor", "period").agg(F.max_by("value", "at").alias("future")), "future")


def dealt_causal(spark: SparkSession, d: str) -> DataFrame:
    return W.windows(st.gappy(spark, d), st.TEST_YEARS, st.TRAIN_YEARS, impute="train")
