"""Signal and portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import portfolio as P
from panelloom.operators import signals as G
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded
from panelloom.plans.standins import sql
from panelloom.session import kept

BOOK = Book()
page = BOOK.page

_A = "OVER (PARTITION BY actor_id ORDER BY quarter)"
_4 = "OVER (PARTITION BY actor_id ORDER BY quarter ROWS 3 PRECEDING)"
_C = "OVER (PARTITION BY quarter)"
_D = "pred_m2 - pred_g1"
_MOM = f"SELECT quarter, actor_id, lag(m) {_A} AS score FROM (SELECT *, CASE WHEN count(return_q) {_4} >= 4 THEN list_product(list_transform(list(return_q) {_4}, lambda x: 1 + x)) - 1 END AS m FROM rets)"
_REV = f"SELECT quarter, actor_id, -lag(return_q) {_A} AS score FROM rets"
_VOL = f"SELECT quarter, actor_id, -lag(s) {_A} AS score FROM (SELECT *, CASE WHEN count(return_q) {_4} >= 4 THEN stddev_samp(return_q) {_4} END AS s FROM rets)"
_GAP = "SELECT quarter, actor_id, pred_m2 - pred_g1 AS score FROM preds"
_M2P = "SELECT quarter, actor_id, pred_m2 AS score FROM preds"
_DELTA = f"SELECT quarter, actor_id, pred_m2 - lag(actual) {_A} AS score FROM preds"
_HIT = "SELECT *, pred_m2 - pred_g1 AS d, CASE WHEN abs(pred_m2 - actual) < abs(pred_g1 - actual) THEN 1.0 ELSE 0.0 END AS hit FROM preds"
_PAST4 = "OVER (PARTITION BY actor_id ORDER BY quarter ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"
_PAST = "OVER (PARTITION BY actor_id ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _z(c: str) -> str:
    return f"({c} - avg({c}) {_C}) / (stddev_samp({c}) {_C} + 1e-8)"


def _blend(*parts: tuple[str, str]) -> str:
    joins = " ".join(f"JOIN ({q}) p{k} USING (quarter, actor_id)" for k, (_, q) in enumerate(parts) if k)
    cols = ", ".join(f"p{k}.score AS s{k}" for k in range(len(parts)))
    known = " AND ".join(f"p{k}.score IS NOT NULL" for k in range(len(parts)))
    return f"SELECT quarter, actor_id, {' + '.join(f'{w} * {_z(f"s{k}")}' for k, (w, _) in enumerate(parts))} AS score FROM (SELECT p0.quarter, p0.actor_id, {cols} FROM ({parts[0][1]}) p0 {joins} WHERE {known})"


_ORACLES: dict[str, str] = {
    "m2": "SELECT quarter, actor_id, -pred_m2 AS score FROM preds", "g1": "SELECT quarter, actor_id, -pred_g1 AS score FROM preds",
    "g0": "SELECT quarter, actor_id, -pred_g0 AS score FROM preds", "ar1": "SELECT quarter, actor_id, -pred_ar1 AS score FROM preds",
    "naive_investment": f"SELECT quarter, actor_id, -lag(actual) {_A} AS score FROM preds", "momentum": _MOM,
    "rank_change_m2": f"SELECT quarter, actor_id, -score AS score FROM ({_DELTA})", "rank_change_m2_positive": _DELTA,
    "disagreement": _GAP, "disagreement_reversed": "SELECT quarter, actor_id, pred_g1 - pred_m2 AS score FROM preds", "abs_disagreement": "SELECT quarter, actor_id, abs(pred_m2 - pred_g1) AS score FROM preds",
    "sector_neutral_m2": "SELECT quarter, actor_id, -(pred_m2 - avg(pred_m2) OVER w) / (stddev_samp(pred_m2) OVER w + 1e-8) AS score FROM preds WINDOW w AS (PARTITION BY quarter, sector)",
    "m2_positive": _M2P, "g1_positive": "SELECT quarter, actor_id, pred_g1 AS score FROM preds",
    "mom_plus_disagr": _blend(("0.5", _MOM), ("0.5", _GAP)), "mom_plus_m2pos": _blend(("0.5", _MOM), ("0.5", _M2P)), "mom_plus_delta": _blend(("0.5", _MOM), ("0.5", _DELTA)),
    "mom_confirmed": f"SELECT quarter, actor_id, CASE WHEN sign(m.score) = sign(g.score) THEN m.score ELSE 0 END AS score FROM (SELECT * FROM ({_MOM}) WHERE score IS NOT NULL) m JOIN ({_GAP}) g USING (quarter, actor_id)",
    "mom_tilt_70_30": _blend(("0.7", _MOM), ("0.3", _GAP)), "reversal_1q": _REV, "low_volatility": _VOL,
    "rev_plus_disagr": _blend(("0.5", _REV), ("0.5", _GAP)), "lowvol_plus_disagr": _blend(("0.5", _VOL), ("0.5", _GAP)), "rev_plus_m2pos": _blend(("0.5", _REV), ("0.5", _M2P)),
    "rev_lowvol_disagr": _blend(("1 / 3", _REV), ("1 / 3", _VOL), ("1 / 3", _GAP)),
    "disagr_self_zscore": f"SELECT quarter, actor_id, CASE WHEN count(d) {_PAST} >= 2 THEN (d - avg(d) {_PAST}) / (stddev_samp(d) {_PAST} + 1e-8) END AS score FROM ({_HIT})",
    "disagr_block_only": f"SELECT quarter, actor_id, d AS score FROM (SELECT *, max(abs(d)) OVER (PARTITION BY actor_id) AS most FROM ({_HIT})) WHERE most > 0.005",
    "disagr_top_quartile": f"SELECT quarter, actor_id, CASE WHEN abs(d) >= quantile_cont(abs(d), 0.75) {_C} THEN d ELSE 0 END AS score FROM ({_HIT})",
    "disagr_accuracy_scaled": f"SELECT quarter, actor_id, d * avg(hit) {_PAST4} AS score FROM ({_HIT})",
    "disagr_conviction": f"SELECT quarter, actor_id, d * s / (median(s) OVER () + 1e-8) AS score FROM (SELECT *, stddev_samp(d) {_C} AS s FROM ({_HIT}))",
    "disagr_combined": f"SELECT quarter, actor_id, d * r * s / (median(s) OVER () + 1e-8) AS score FROM (SELECT *, stddev_samp(d) {_C} AS s FROM (SELECT *, coalesce(avg(hit) {_PAST4}, 0.5) AS r, max(abs(d)) OVER (PARTITION BY actor_id) AS most FROM ({_HIT})) WHERE most > 0.005)",
}

for _name, _signal in (G.SIGNALS | G.COMBINATIONS).items():
    BOOK.add(
        f"signal_{_name}",
        lambda spark, d, s=_signal: rounded(s(st.predictions(spark, d), st.returns(spark, d)).where("score is not null"), "score", digits=5),
        sql(f"SELECT quarter, actor_id, round(score, 5) AS score FROM ({_ORACLES[_name]}) WHERE score IS NOT NULL", "preds", "rets"),
        "quarter",
    )

# The tables' disagreements stay below .005: with a gap that they do reach, the two filters show rows.
for _name, _signal_of in {"disagr_block_only": G.block_only, "disagr_combined": G.combined}.items():
    BOOK.add(
        f"signal_{_name}_small_gap",
        lambda spark, d, s=_signal_of: rounded(s(st.predictions(spark, d), st.returns(spark, d), least=0.0003).where("score is not null"), "score", digits=7),
        sql(f"SELECT quarter, actor_id, round(score, 7) AS score FROM ({_ORACLES[_name].replace('0.005', '0.0003')}) WHERE score IS NOT NULL", "preds", "rets"),
        "quarter",
    )

# --- portfolios of the disagreement signal -----------------------------------------------------------------------------

_EDGES = ", ".join(f"quantile_cont(score, {p!r})" for p in (i * 0.2 for i in range(6)))
_PARTS = {
    "sig": "SELECT quarter, actor_id, round(pred_m2 - pred_g1, 9) AS score FROM preds",
    "pairs_": "SELECT quarter, actor_id, score, return_q FROM sig JOIN rets USING (quarter, actor_id) WHERE score IS NOT NULL",
    "edges": f"SELECT quarter, list_distinct([{_EDGES}]) AS e FROM pairs_ GROUP BY 1",
    "sorted_": "SELECT quarter, actor_id, score, return_q, CAST(greatest(1, len(list_filter(e, lambda x: x < score))) AS INTEGER) AS quintile FROM pairs_ JOIN edges USING (quarter)",
}
_LS = "SELECT quarter, long, short, long - short AS spread FROM (SELECT quarter, avg(return_q) FILTER (quintile = t) AS long, avg(return_q) FILTER (quintile = b) AS short FROM sorted_, (SELECT CASE WHEN bool_or(quintile = 5) THEN 5 ELSE max(quintile) END AS t, CASE WHEN bool_or(quintile = 1) THEN 1 ELSE min(quintile) END AS b FROM sorted_) GROUP BY 1) WHERE long IS NOT NULL AND short IS NOT NULL"
_LO = "SELECT quarter, avg(return_q) FILTER (quintile = 5) AS long, avg(return_q) AS equal_weight, avg(return_q) FILTER (quintile = 5) - avg(return_q) AS active FROM sorted_ GROUP BY 1 HAVING avg(return_q) FILTER (quintile = 5) IS NOT NULL"


@page(sql("SELECT quarter, actor_id, quintile FROM sorted_", "preds", "rets", **_PARTS), dates="quarter")
def quintile_sort(spark: SparkSession, d: str) -> DataFrame:
    return st.sorted_signal(spark, d).select("quarter", "actor_id", "quintile")


@page(sql("SELECT quarter, round(long, 6) AS long, round(short, 6) AS short, round(spread, 6) AS spread FROM ls", "preds", "rets", **_PARTS, ls=_LS), dates="quarter")
def long_short(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.long_short(st.sorted_signal(spark, d)), "long", "short", "spread")


@page(sql("SELECT quarter, round(long, 6) AS long, round(equal_weight, 6) AS equal_weight, round(active, 6) AS active FROM lo", "preds", "rets", **_PARTS, lo=_LO), dates="quarter")
def long_only(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.long_only(st.sorted_signal(spark, d)), "long", "equal_weight", "active")


@page(sql("SELECT quarter, round(CASE WHEN p IS NULL THEN 1 ELSE 1 - len(list_intersect(a, p)) / greatest(len(a), len(p)) END, 6) AS turnover FROM (SELECT quarter, a, lag(a) OVER (ORDER BY quarter) AS p FROM (SELECT quarter, list(DISTINCT actor_id) AS a FROM sorted_ WHERE quintile = 5 GROUP BY 1))", "preds", "rets", **_PARTS), dates="quarter")
def turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.turnover(st.sorted_signal(spark, d).where("quintile = 5")), "turnover")


_RANKED = f"SELECT *, count(*) {_C} AS names, row_number() OVER (PARTITION BY quarter ORDER BY score DESC, actor_id DESC) AS hi, row_number() OVER (PARTITION BY quarter ORDER BY score, actor_id) AS lo FROM pairs_"


def _top(n: str, sides: int) -> str:
    return sql(f"SELECT quarter, round(avg(return_q) FILTER (hi <= n), 6) AS long, round(avg(return_q) FILTER (lo <= n), 6) AS short, round(avg(return_q), 6) AS equal_weight, any_value(n) AS held FROM (SELECT *, CAST({n} AS INTEGER) AS n FROM ranked) WHERE names >= {sides} * n GROUP BY 1", "preds", "rets", **_PARTS, ranked=_RANKED)


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return G.SIGNALS["disagreement"](st.predictions(spark, d), st.returns(spark, d)).withColumn("score", F.round("score", 9))


@page(_top("3", 2), dates="quarter")
def topn_ls(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.top_n(_signal(spark, d), st.returns(spark, d), n=3), "long", "short", "equal_weight")


@page(_top("greatest(3, floor(names * 0.33))", 1), dates="quarter")
def topfrac_sector(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.top_n(_signal(spark, d), st.returns(spark, d), fraction=0.33, least=3, sides=1), "long", "short", "equal_weight")


@page(sql("SELECT quarter, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.7 * a + 0.3 * b ELSE coalesce(a, b) END, 6) AS rotated, round(ew, 6) AS equal_weight FROM (SELECT quarter, avg(r) FILTER (up) AS a, avg(r) FILTER (NOT up) AS b, avg(r) AS ew FROM (SELECT *, s > median(s) OVER (PARTITION BY sector) AS up FROM (SELECT quarter, sector, r, lag(s) OVER (PARTITION BY sector ORDER BY quarter) AS s FROM (SELECT quarter, sector, avg(score) AS s, avg(return_q) AS r FROM pairs_ JOIN registry ON actor = actor_id GROUP BY 1, 2)) WHERE s IS NOT NULL) GROUP BY 1)", "preds", "rets", "registry", **_PARTS), dates="quarter")
def sector_rotation(spark: SparkSession, d: str) -> DataFrame:
    sectors = st.registry(spark, d).select(F.col("actor").alias("actor_id"), "sector")
    return rounded(P.sector_rotation(_signal(spark, d), sectors, st.returns(spark, d)), "rotated", "equal_weight")


for _k in (1, 2, -1):
    _w = f"lag(score, {_k})" if _k > 0 else f"lead(score, {-_k})"
    BOOK.add(
        f"signal_lagged_{'lead' if _k < 0 else 'lag'}{abs(_k)}",
        lambda spark, d, k=_k: rounded(P.lagged(_signal(spark, d), k).select("quarter", "actor_id", "score"), "score"),
        sql(f"SELECT quarter, actor_id, round(score, 6) AS score FROM (SELECT quarter, actor_id, {_w} {_A} AS score FROM sig) WHERE score IS NOT NULL", "preds", sig=_PARTS["sig"]),
        "quarter",
    )


@page(sql(f"SELECT quarter, actor_id, round(score, 6) AS score FROM (SELECT *, lag(score) {_A} AS b FROM sig) WHERE sign(score) = sign(b)", "preds", sig=_PARTS["sig"]), dates="quarter")
def persistence_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.persistent(_signal(spark, d)).select("quarter", "actor_id", "score"), "score")


# --- performance: every actor's own return series ------------------------------------------------------------------------


def _series(spark: SparkSession, d: str) -> DataFrame:
    return st.returns(spark, d).select("actor_id", "quarter", F.col("return_q").alias("r"))


_CUM = "SELECT actor_id, quarter, return_q AS r, exp(sum(ln(1 + return_q)) OVER (PARTITION BY actor_id ORDER BY quarter ROWS UNBOUNDED PRECEDING)) AS c FROM rets"


@page(sql("SELECT actor_id, round(max((peak - c) / peak), 5) AS max_drawdown FROM (SELECT *, max(c) OVER (PARTITION BY actor_id ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS peak FROM cum) GROUP BY 1", "rets", cum=_CUM))
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.performance(_series(spark, d), ["actor_id"]).select("actor_id", "max_drawdown"), "max_drawdown", digits=5)


@page(sql("SELECT actor_id, count(*) AS n, round(exp(sum(ln(1 + return_q)) * 4 / count(*)) - 1, 5) AS ann_return, round(stddev_samp(return_q) * 2, 5) AS ann_vol, round(avg(return_q) / stddev_samp(return_q) * 2, 5) AS sharpe, round(avg(CASE WHEN return_q > 0 THEN 1.0 ELSE 0.0 END), 5) AS hit_rate, round(skewness_pop, 3) AS skew, round(kurt, 3) AS kurt FROM rets JOIN (SELECT actor_id, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skewness_pop, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS kurt FROM (SELECT actor_id, return_q AS r, avg(return_q) OVER (PARTITION BY actor_id) AS m FROM rets) GROUP BY 1) USING (actor_id) GROUP BY actor_id, skewness_pop, kurt", "rets"))
def sharpe_moments(spark: SparkSession, d: str) -> DataFrame:
    p = P.performance(_series(spark, d), ["actor_id"]).select("actor_id", "n", "ann_return", "ann_vol", "sharpe", "hit_rate", "skew", "kurt")
    return rounded(rounded(p, "ann_return", "ann_vol", "sharpe", "hit_rate", digits=5), "skew", "kurt", digits=3)


def _cdf(x: str) -> str:
    """As functions.semantics.normal_cdf."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    tail = f"(exp(-pow({x}, 2) / 2) / sqrt(2 * pi()) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


@page(sql(
    f"SELECT actor_id, round(CASE WHEN n < 3 OR skew IS NULL THEN 0.5 WHEN se2 > 0 THEN {_cdf('(sharpe / sqrt(se2))')} WHEN sharpe > 0 THEN 1 ELSE 0 END, 5) AS psr, round(CASE WHEN fall > 0 THEN ann / fall ELSE 0 END, 5) AS calmar FROM e JOIN falls USING (actor_id)", "rets",
    cum=_CUM, falls="SELECT actor_id, max((peak - c) / peak) AS fall FROM (SELECT *, max(c) OVER (PARTITION BY actor_id ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS peak FROM cum) GROUP BY 1",
    m="SELECT *, return_q - avg(return_q) OVER (PARTITION BY actor_id) AS x FROM rets",
    s="SELECT actor_id, count(*) AS n, avg(return_q) AS mean, coalesce(stddev_samp(return_q), 0) AS sd, avg(pow(x, 3)) / nullif(pow(avg(x * x), 1.5), 0) AS skew, avg(pow(x, 4)) / nullif(pow(avg(x * x), 2), 0) AS kurt, exp(sum(ln(1 + return_q)) * 4 / count(*)) - 1 AS ann FROM m GROUP BY 1",
    e0="SELECT *, CASE WHEN sd > 1e-15 THEN mean / sd * 2 ELSE 0 END AS sharpe FROM s", e="SELECT *, (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1) AS se2 FROM e0",
))
def probabilistic_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.performance(_series(spark, d), ["actor_id"]).select("actor_id", "psr", "calmar"), "psr", "calmar", digits=5)


@page(sql("SELECT round(CASE WHEN stddev_samp(active) > 1e-15 THEN avg(active) / stddev_samp(active) * 2 ELSE 0 END, 5) AS ir, round(avg(active) / (stddev_samp(active) / sqrt(count(active))), 5) AS t, count(active) AS n, CASE WHEN quarter < DATE '2000-01-01' THEN 'pre' ELSE 'post' END AS part FROM lo GROUP BY part", "preds", "rets", **_PARTS, lo=_LO))
def information_ratio(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("quarter") < F.lit("2000-01-01").cast("date"), "pre").otherwise("post")
    return rounded(P.information_ratio(P.long_only(st.sorted_signal(spark, d)).withColumn("part", part), ["part"]), "ir", "t", digits=5)


@page(sql("SELECT quarter, round(active, 6) AS active, round(list_product(list_transform(list(active) OVER (ORDER BY quarter ROWS UNBOUNDED PRECEDING), lambda x: 1 + x)) - 1, 6) AS cumulative FROM lo", "preds", "rets", **_PARTS, lo=_LO), dates="quarter")
def cumulative_active(spark: SparkSession, d: str) -> DataFrame:
    lo = P.long_only(st.sorted_signal(spark, d)).withColumn("all", F.lit(1))
    return rounded(P.cumulative(lo, ["all"]).select("quarter", "active", "cumulative"), "active", "cumulative")


@page(sql("SELECT quarter, round(spread, 6) AS spread, round(spread - turnover * 2 * 10 / 10000, 6) AS net FROM ls JOIN (SELECT quarter, CASE WHEN p IS NULL THEN 1 ELSE 1 - len(list_intersect(a, p)) / greatest(len(a), len(p)) END AS turnover FROM (SELECT quarter, a, lag(a) OVER (ORDER BY quarter) AS p FROM (SELECT quarter, list(DISTINCT actor_id) AS a FROM sorted_ WHERE quintile = 5 GROUP BY 1))) USING (quarter)", "preds", "rets", **_PARTS, ls=_LS), dates="quarter")
def cost_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    s = st.sorted_signal(spark, d)
    return rounded(P.net_of_costs(P.long_short(s), P.turnover(s.where("quintile = 5")), 10).select("quarter", "spread", "net"), "spread", "net")


@page(sql("SELECT quintile, round(mean, 6) AS mean, mean > lag(mean) OVER (ORDER BY quintile) AS rises FROM (SELECT quintile, avg(return_q) AS mean FROM sorted_ GROUP BY 1)", "preds", "rets", **_PARTS))
def monotonicity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.monotonicity(st.sorted_signal(spark, d)), "mean")


@page(sql("SELECT actor_id, quarter, round(close / lag(close) OVER (PARTITION BY actor_id ORDER BY quarter) - 1, 6) AS return_q FROM (SELECT l_suppkey AS actor_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, arg_max(price, (l_shipdate, price)) AS close FROM (SELECT *, round(l_extendedprice / l_quantity, 6) AS price FROM lineitem) GROUP BY 1, 2) QUALIFY lag(close) OVER (PARTITION BY actor_id ORDER BY quarter) IS NOT NULL"), dates="quarter")
def quarterly_returns(spark: SparkSession, d: str) -> DataFrame:
    li = st.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("actor_id"), F.col("l_shipdate").alias("ts"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6).alias("price"))
    return rounded(P.quarterly_returns(li), "return_q")


_REGIME = {
    "hits": "SELECT quarter, avg(CASE WHEN abs(pred_m2 - actual) < abs(pred_g1 - actual) THEN 1.0 ELSE 0.0 END) AS h FROM preds GROUP BY 1",
    "rate": "SELECT quarter, avg(h) OVER (ORDER BY quarter ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lag_hit FROM hits",
    "grp": "SELECT quarter, avg(return_q) FILTER (layer = 0) AS a, avg(return_q) FILTER (layer <> 0) AS b, avg(return_q) AS ew FROM rets JOIN registry ON actor = actor_id GROUP BY 1",
    "reg": "SELECT *, lag_hit >= (SELECT median(lag_hit) FROM rate JOIN grp USING (quarter) WHERE lag_hit IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL) AS up FROM rate JOIN grp USING (quarter) WHERE lag_hit IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL",
}


@page(sql("SELECT quarter, round(lag_hit, 6) AS lag_hit, round(CASE WHEN up THEN 0.7 * a + 0.3 * b ELSE 0.3 * a + 0.7 * b END, 6) AS overweight, round(CASE WHEN NOT up THEN 0.7 * a + 0.3 * b ELSE 0.3 * a + 0.7 * b END, 6) AS underweight, round(ew, 6) AS equal_weight FROM reg", "preds", "rets", "registry", **_REGIME), dates="quarter")
def regime_rotation(spark: SparkSession, d: str) -> DataFrame:
    p = st.predictions(spark, d)
    closer = F.abs(F.col("pred_m2") - F.col("actual")) < F.abs(F.col("pred_g1") - F.col("actual"))
    inside = st.registry(spark, d).select(F.col("actor").alias("actor_id"), (F.col("layer") == 0).alias("inside"))
    hits = p.select("quarter", F.when(closer, 1.0).otherwise(0.0).alias("hit"))
    out = P.regime_rotation(hits, st.returns(spark, d).join(inside, "actor_id"))
    return rounded(out, "lag_hit", "overweight", "underweight", "equal_weight")


_EVERY = " UNION ALL ".join(f"SELECT '{name}' AS strategy, quarter, actor_id, round(score, 9) AS score FROM ({q}) WHERE score IS NOT NULL" for name, q in _ORACLES.items())
_TABLE = {
    "sigs": _EVERY,
    "pairs_": "SELECT strategy, quarter, actor_id, score, return_q FROM sigs JOIN rets USING (quarter, actor_id)",
    "edges": f"SELECT strategy, quarter, list_distinct([{_EDGES}]) AS e FROM pairs_ GROUP BY 1, 2",
    "sorted_": "SELECT strategy, quarter, actor_id, return_q, CAST(greatest(1, len(list_filter(e, lambda x: x < score))) AS INTEGER) AS quintile FROM pairs_ JOIN edges USING (strategy, quarter)",
    "ends": "SELECT strategy, CASE WHEN bool_or(quintile = 5) THEN 5 ELSE max(quintile) END AS t, CASE WHEN bool_or(quintile = 1) THEN 1 ELSE min(quintile) END AS b FROM sorted_ GROUP BY 1",
    "ls": "SELECT strategy, quarter, avg(return_q) FILTER (quintile = t) - avg(return_q) FILTER (quintile = b) AS r FROM sorted_ JOIN ends USING (strategy) GROUP BY 1, 2",
    "lo": "SELECT strategy, quarter, avg(return_q) FILTER (quintile = 5) AS r, avg(return_q) FILTER (quintile = 5) - avg(return_q) AS active FROM sorted_ GROUP BY 1, 2",
    "series": "SELECT * FROM ls WHERE r IS NOT NULL UNION ALL SELECT 'equal_weight', quarter, avg(return_q) FROM rets GROUP BY quarter",
    "cum": "SELECT strategy, quarter, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY quarter ROWS UNBOUNDED PRECEDING)) AS c FROM series",
    "falls": "SELECT strategy, max((peak - c) / peak) AS fall FROM (SELECT *, max(c) OVER (PARTITION BY strategy ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS peak FROM cum) GROUP BY 1",
    "m": "SELECT *, r - avg(r) OVER (PARTITION BY strategy) AS x FROM series",
    "s": "SELECT strategy, count(*) AS n, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS sd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(pow(x, 3)) / nullif(pow(avg(x * x), 1.5), 0) AS skew, avg(pow(x, 4)) / nullif(pow(avg(x * x), 2), 0) AS kurt, exp(sum(ln(1 + r)) * 4 / count(*)) - 1 AS ann FROM m GROUP BY 1",
    "e0": "SELECT *, CASE WHEN sd > 1e-15 THEN mean / sd * 2 ELSE 0 END AS sharpe FROM s",
    "e": "SELECT *, (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1) AS se2 FROM e0",
    "longs": "SELECT strategy, exp(sum(ln(1 + r)) * 4 / count(*)) - 1 AS lo_ann_return, CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * 2 ELSE 0 END AS lo_sharpe, CASE WHEN stddev_samp(active) > 1e-15 THEN avg(active) / stddev_samp(active) * 2 ELSE 0 END AS ir FROM lo WHERE r IS NOT NULL GROUP BY 1",
    "held": "SELECT strategy, quarter, list(DISTINCT actor_id) AS a FROM sorted_ WHERE quintile = 5 GROUP BY 1, 2",
    "turns": "SELECT strategy, avg(1 - len(list_intersect(a, p)) / greatest(len(a), len(p))) AS mean_turnover FROM (SELECT *, lag(a) OVER (PARTITION BY strategy ORDER BY quarter) AS p FROM held) WHERE p IS NOT NULL GROUP BY 1",
}


@page(sql(
    f"SELECT strategy, n, round(ann, 4) AS ann_return, round(sd * 2, 4) AS ann_vol, round(sharpe, 4) AS sharpe, round(fall, 4) AS max_drawdown, round(CASE WHEN fall > 0 THEN ann / fall ELSE 0 END, 4) AS calmar, round(hit_rate, 4) AS hit_rate, round(skew, 4) AS skew, round(kurt, 4) AS kurt, round(CASE WHEN n < 3 OR skew IS NULL THEN 0.5 WHEN se2 > 0 THEN {_cdf('(sharpe / sqrt(se2))')} WHEN sharpe > 0 THEN 1 ELSE 0 END, 4) AS psr, round(lo_ann_return, 4) AS lo_ann_return, round(lo_sharpe, 4) AS lo_sharpe, round(ir, 4) AS ir, round(mean_turnover, 4) AS mean_turnover FROM e JOIN falls USING (strategy) LEFT JOIN longs USING (strategy) LEFT JOIN turns USING (strategy)",
    "preds", "rets", **_TABLE,
))
def strategy_table(spark: SparkSession, d: str) -> DataFrame:
    """All signals' figures in one table, and those of all actors weighted alike."""
    preds, rets = st.predictions(spark, d), st.returns(spark, d)

    def sorts() -> DataFrame:
        out = None
        for name, signal in (G.SIGNALS | G.COMBINATIONS).items():
            one = signal(preds, rets).select(F.lit(name).alias("strategy"), "quarter", "actor_id", F.round("score", 9).alias("score"))
            out = one if out is None else out.unionByName(one)
        return P.quintile_sort(P.long_enough(out), rets, ["strategy"])

    # Six figures are taken from the sort: one value a strategy, quarter and actor.
    table = P.strategies(kept(spark, d, "sorted_strategies", sorts))
    alike = rets.groupBy("quarter").agg(F.avg("return_q").alias("r")).withColumn("strategy", F.lit(G.EQUAL_WEIGHT))
    table = table.unionByName(P.performance(alike, ["strategy"]), allowMissingColumns=True)
    return rounded(table, *[c for c, t in table.dtypes if t == "double"], digits=4)
