"""Trading signals: predictions and returns to (quarter, actor_id, score), by window expressions.

Predictions: (quarter, actor_id, sector, actual, pred_g0, pred_g1, pred_m2, pred_ar1). Returns: (quarter,
actor_id, return_q). Lags go by position, not by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelloom.functions import semantics as S

Signal = Callable[[DataFrame, DataFrame], DataFrame]

EPS = 1e-8
#: What stands for the signal that weighs all actors alike.
EQUAL_WEIGHT = "equal_weight"


def _by_actor() -> WindowSpec:
    return Window.partitionBy("actor_id").orderBy("quarter")


def _last4() -> WindowSpec:
    return _by_actor().rowsBetween(-3, 0)


def _cross() -> WindowSpec:
    return Window.partitionBy("quarter")


def _scored(df: DataFrame, score: Column, drop_null: bool = True) -> DataFrame:
    out = df.select("quarter", "actor_id", score.alias("score"))
    return out.where("score is not null") if drop_null else out


def of_prediction(column: str, sign: int = -1) -> Signal:
    """sign * forecast: by default low forecast investment scores high."""
    return lambda preds, _: _scored(preds, sign * F.col(column), False)


def naive_investment(preds: DataFrame, returns: DataFrame) -> DataFrame:
    return _scored(preds, -F.lag("actual").over(_by_actor()))


def momentum(preds: DataFrame, returns: DataFrame) -> DataFrame:
    """Compound return of four quarters, one quarter late."""
    r = returns.withColumn("m__", S.compound(F.col("return_q"), _last4(), 4))
    return _scored(r, F.lag("m__").over(_by_actor()))


def rank_change(sign: int) -> Signal:
    return lambda preds, _: _scored(preds, sign * (F.col("pred_m2") - F.lag("actual").over(_by_actor())))


def disagreement(sign: int = 1, absolute: bool = False) -> Signal:
    def run(preds: DataFrame, returns: DataFrame) -> DataFrame:
        d = F.col("pred_m2") - F.col("pred_g1")
        return _scored(preds, F.abs(d) if absolute else sign * d, False)

    return run


def sector_neutral(preds: DataFrame, returns: DataFrame) -> DataFrame:
    w = Window.partitionBy("quarter", "sector")
    return _scored(preds, -(F.col("pred_m2") - F.avg("pred_m2").over(w)) / (F.stddev_samp("pred_m2").over(w) + EPS), False)


def reversal(preds: DataFrame, returns: DataFrame) -> DataFrame:
    return _scored(returns, -F.lag("return_q").over(_by_actor()))


def low_volatility(preds: DataFrame, returns: DataFrame) -> DataFrame:
    r = returns.withColumn("s__", S.rolling(F.stddev_samp, F.col("return_q"), _last4(), 4))
    return _scored(r, -F.lag("s__").over(_by_actor()))


def _z(column: str) -> Column:
    return (F.col(column) - F.avg(column).over(_cross())) / (F.stddev_samp(column).over(_cross()) + EPS)


def blend(*parts: tuple[float, Signal]) -> Signal:
    """Weighted sum of z-scores within the quarter, taken after the signals are joined on (quarter, actor)."""

    def run(preds: DataFrame, returns: DataFrame) -> DataFrame:
        joined = None
        for k, (_, signal) in enumerate(parts):
            one = signal(preds, returns).withColumnRenamed("score", f"s{k}")
            joined = one if joined is None else joined.join(one, ["quarter", "actor_id"])
        total = sum((F.lit(w) * _z(f"s{k}") for k, (w, _) in enumerate(parts)), F.lit(0.0))
        return _scored(joined, total, False)

    return run


def momentum_confirmed(preds: DataFrame, returns: DataFrame) -> DataFrame:
    """Momentum where the disagreement has its sign, else 0."""
    m = momentum(preds, returns).withColumnRenamed("score", "m")
    d = disagreement()(preds, returns).withColumnRenamed("score", "d")
    return _scored(m.join(d, ["quarter", "actor_id"]), F.when(F.signum("m") == F.signum("d"), F.col("m")).otherwise(F.lit(0.0)))


def _with_gap(preds: DataFrame) -> DataFrame:
    return preds.withColumn("d", F.col("pred_m2") - F.col("pred_g1"))


def self_zscore(preds: DataFrame, returns: DataFrame) -> DataFrame:
    """Disagreement against the actor's own earlier ones, of which two at least are needed."""
    past = _by_actor().rowsBetween(Window.unboundedPreceding, -1)
    x = _with_gap(preds)
    return _scored(x, F.when(F.count("d").over(past) >= 2, (F.col("d") - F.avg("d").over(past)) / (F.stddev_samp("d").over(past) + EPS)))


def block_only(preds: DataFrame, returns: DataFrame, least: float = 0.005) -> DataFrame:
    """Actors whose disagreement ever exceeds ``least``; "ever" looks ahead."""
    x = _with_gap(preds).withColumn("most", F.max(F.abs("d")).over(Window.partitionBy("actor_id")))
    return _scored(x.where(F.col("most") > least), F.col("d"), False)


def top_quartile(preds: DataFrame, returns: DataFrame) -> DataFrame:
    x = _with_gap(preds).withColumn("q", F.percentile(F.abs("d"), F.lit(0.75)).over(_cross()))
    return _scored(x, F.when(F.abs("d") >= F.col("q"), F.col("d")).otherwise(F.lit(0.0)), False)


def hit_rate(width: int = 4) -> Column:
    """How often, of the last ``width`` quarters up to the one before, M2 was closer than G1."""
    return F.avg("hit__").over(_by_actor().rowsBetween(-width, -1))


def _with_hit(preds: DataFrame) -> DataFrame:
    closer = F.abs(F.col("pred_m2") - F.col("actual")) < F.abs(F.col("pred_g1") - F.col("actual"))
    return _with_gap(preds).withColumn("hit__", F.when(closer, 1.0).otherwise(0.0))


def accuracy_scaled(width: int = 4, missing: float | None = None) -> Signal:
    def run(preds: DataFrame, returns: DataFrame) -> DataFrame:
        rate = hit_rate(width) if missing is None else F.coalesce(hit_rate(width), F.lit(missing))
        return _scored(_with_hit(preds), F.col("d") * rate)

    return run


def _conviction(x: DataFrame) -> DataFrame:
    """Spread of the quarter's disagreements over its median row's."""
    spread = x.withColumn("s__", F.stddev_samp("d").over(_cross()))
    middle = spread.agg(F.median("s__").alias("median__"))
    return spread.crossJoin(F.broadcast(middle)).withColumn("c__", F.col("s__") / (F.col("median__") + EPS))


def conviction(preds: DataFrame, returns: DataFrame) -> DataFrame:
    return _scored(_conviction(_with_gap(preds)), F.col("d") * F.col("c__"), False)


def combined(preds: DataFrame, returns: DataFrame, least: float = 0.005) -> DataFrame:
    """Block filter (disagreement that ever exceeds ``least``), hit rate (0.5 if unknown) and conviction in one."""
    x = _with_hit(preds).withColumn("rate__", F.coalesce(hit_rate(), F.lit(0.5))).withColumn("most", F.max(F.abs("d")).over(Window.partitionBy("actor_id"))).where(F.col("most") > least)
    return _scored(_conviction(x), F.col("d") * F.col("rate__") * F.col("c__"), False)


SIGNALS: dict[str, Signal] = {
    "m2": of_prediction("pred_m2"), "g1": of_prediction("pred_g1"), "g0": of_prediction("pred_g0"), "ar1": of_prediction("pred_ar1"),
    "naive_investment": naive_investment, "momentum": momentum,
    "rank_change_m2": rank_change(-1), "rank_change_m2_positive": rank_change(1),
    "disagreement": disagreement(), "disagreement_reversed": disagreement(-1), "abs_disagreement": disagreement(absolute=True),
    "sector_neutral_m2": sector_neutral, "m2_positive": of_prediction("pred_m2", 1), "g1_positive": of_prediction("pred_g1", 1),
}
_half = lambda a, b: blend((0.5, a), (0.5, b))
COMBINATIONS: dict[str, Signal] = {
    "mom_plus_disagr": _half(momentum, SIGNALS["disagreement"]), "mom_plus_m2pos": _half(momentum, SIGNALS["m2_positive"]),
    "mom_plus_delta": _half(momentum, SIGNALS["rank_change_m2_positive"]), "mom_confirmed": momentum_confirmed,
    "mom_tilt_70_30": blend((0.7, momentum), (0.3, SIGNALS["disagreement"])),
    "reversal_1q": reversal, "low_volatility": low_volatility,
    "rev_plus_disagr": _half(reversal, SIGNALS["disagreement"]), "lowvol_plus_disagr": _half(low_volatility, SIGNALS["disagreement"]),
    "rev_plus_m2pos": _half(reversal, SIGNALS["m2_positive"]),
    "rev_lowvol_disagr": blend((1 / 3, reversal), (1 / 3, low_volatility), (1 / 3, SIGNALS["disagreement"])),
    "disagr_self_zscore": self_zscore, "disagr_block_only": block_only, "disagr_top_quartile": top_quartile,
    "disagr_accuracy_scaled": accuracy_scaled(), "disagr_conviction": conviction, "disagr_combined": combined,
}
