"""Intensities: a long panel (actor, period, value) to normalised values, still long.

Every function takes and returns a DataFrame, keeps the other columns, and adds one named ``out``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import order as O
from panelloom.functions import semantics as S

V = "value"


def cross_section_rank(panel: DataFrame, out: str = "rank") -> DataFrame:
    return O.ranked(panel, {out: V}, "period", share=True)


def cross_section_minmax(panel: DataFrame, out: str = "scaled") -> DataFrame:
    """Within a period; 0.5 if all its values are equal."""
    return panel.withColumn(out, S.minmax(F.col(V), Window.partitionBy("period"), degenerate=0.5))


def time_series_minmax(panel: DataFrame, out: str = "scaled", degenerate: float | None = None) -> DataFrame:
    """Over an actor's whole history: it looks ahead. See recursive_minmax for the causal form."""
    return panel.withColumn(out, S.minmax(F.col(V), Window.partitionBy("actor"), degenerate))


def recursive_minmax(panel: DataFrame, out: str = "scaled") -> DataFrame:
    """Min and max of what an actor has shown so far; 0.5 while the span is 1e-10 or less."""
    so_far = Window.partitionBy("actor").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(out, S.minmax(F.col(V), so_far, degenerate=0.5, tolerance=1e-10))


def zscore_sigmoid(panel: DataFrame, out: str = "squashed") -> DataFrame:
    return panel.withColumn(out, S.sigmoid(S.zscore(F.col(V), Window.partitionBy("actor"))))


def rank_or_fallback(panel: DataFrame, out: str = "intensity") -> DataFrame:
    """Cross-section rank; an actor whose ranks never move gets its z-score's sigmoid, or 0.5 if its values never move either."""
    own = Window.partitionBy("actor")
    ranked = zscore_sigmoid(cross_section_rank(panel, "r__"), "z__")
    still = F.coalesce(F.stddev_samp("r__").over(own), F.lit(0.0)) == 0
    flat = F.coalesce(F.stddev_samp(V).over(own), F.lit(0.0)) == 0
    value = F.when(~still, F.col("r__")).when(~flat, F.col("z__")).otherwise(F.lit(0.5))
    return ranked.withColumn(out, F.when(F.col(V).isNotNull(), value)).drop("r__", "z__")


def growth(panel: DataFrame, periods: int = 4, out: str = "growth") -> DataFrame:
    """x / lag(x) - 1 by position on a complete grid; null where the base is null or 0."""
    before = F.lag(V, periods).over(Window.partitionBy("actor").orderBy("period"))
    return panel.withColumn(out, F.when(before != 0, F.col(V) / before - 1))


def grid(panel: DataFrame) -> DataFrame:
    """Every actor in every period that the panel holds: (actor, period, value, others null)."""
    periods, actors = panel.select("period").distinct(), panel.select("actor").distinct()
    return actors.crossJoin(periods).join(panel, ["actor", "period"], "left")  # periods: a calendar's length


def forward_fill(panel: DataFrame, limit: int | None = None, out: str = "filled") -> DataFrame:
    """Last known value, at most ``limit`` periods old, on the completed grid."""
    frame = Window.partitionBy("actor").orderBy("period").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return grid(panel).withColumn(out, F.last(V, ignorenulls=True).over(frame))


def ratio_panel(top: DataFrame, bottom: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Rank of top/bottom where bottom isn't 0, for actors with values in more than ``at_least`` of all periods."""
    x = top.withColumnRenamed(V, "top").join(bottom.withColumnRenamed(V, "bottom"), ["actor", "period"]).withColumn(V, F.try_divide("top", "bottom"))
    n = x.select(F.count_distinct("period").alias("n_periods"))
    ranked = cross_section_rank(x).select("actor", "period", "rank")
    held = ranked.groupBy("actor").agg(F.count("rank").alias("held")).crossJoin(F.broadcast(n)).where(F.col("held") > at_least * F.col("n_periods")).select("actor")
    return ranked.join(held, "actor", "left_semi")


def capex_ratio(flows: DataFrame, signed: bool = False) -> DataFrame:
    """capex / assets where assets > 0: below 0 is 0; ``signed``: the absolute value, at most 1."""
    good = F.when(F.col("assets") > 0, F.col("assets"))
    ratio = F.least(F.abs("capex") / good, F.lit(1.0)) if signed else F.greatest(F.col("capex") / good, F.lit(0.0))
    return flows.withColumn("ratio", F.when(good.isNotNull() & F.col("capex").isNotNull(), ratio))


def cumulative_change(panel: DataFrame, out: str = "change") -> DataFrame:
    """Forward-filled level less the first known one."""
    own = Window.partitionBy("actor").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return forward_fill(panel, out="filled__").withColumn(out, F.col("filled__") - F.first(V, ignorenulls=True).over(own)).drop("filled__")


def firm_lag(panel: DataFrame, registry: DataFrame, k: int = 1, layer: int = 2, out: str = "lagged") -> DataFrame:
    """Values of ``layer``'s actors ``k`` periods late, others unchanged."""
    late = F.lag(V, k).over(Window.partitionBy("actor").orderBy("period"))
    return panel.join(registry.select("actor", "layer"), "actor", "left").withColumn(out, F.when(F.col("layer") == layer, late).otherwise(F.col(V))).drop("layer")


# --- transforms of the forecasting target --------------------------------------------------------------------


def _moving(n: int) -> Callable[[DataFrame], Column]:
    return lambda _: F.avg(V).over(Window.partitionBy("actor").orderBy("period").rowsBetween(1 - n, 0))


#: Coefficients of Acklam's approximation, numerator and denominator of the middle part, then of the tails.
NORMAL_MIDDLE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572),
)
NORMAL_TAIL = (
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416),
)


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function by Acklam's rational forms (relative error < 1.2e-9) for 0.02425 <= p <= 0.97575, and its tail form beyond."""
    # Fixed values of the approximation.
    (a, b), (c, d) = NORMAL_MIDDLE, NORMAL_TAIL

    def poly(x: Column, terms: tuple[float, ...]) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    q = p - 0.5
    middle = poly(q * q, a) * q / poly(q * q, (*b, 1.0))
    tail = lambda u: poly(F.sqrt(-2 * F.log(u)), c) / poly(F.sqrt(-2 * F.log(u)), (*d, 1.0))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)


def target_transforms() -> dict[str, Callable[[DataFrame], Column]]:
    """Name -> column over (actor, period, value, sector, and rank__, the cross-section rank, for the first two)."""
    cross = Window.partitionBy("period")
    return {
        "ranks": lambda _: F.col("rank__"),
        # least and greatest pass over nulls, which must stay.
        "normal_quantiles": lambda _: F.when(F.col(V).isNotNull(), normal_quantile(F.greatest(F.least("rank__", F.lit(0.995)), F.lit(0.005)))),
        "winsorized_z": lambda _: F.greatest(F.least(S.zscore(F.col(V), cross), F.lit(2.0)), F.lit(-2.0)),
        "sector_relative": lambda _: F.col(V) - F.avg(V).over(Window.partitionBy("period", "sector")),
        "ma2": _moving(2),
        "ma4": _moving(4),
        "changes": lambda _: F.col(V) - F.lag(V).over(Window.partitionBy("actor").orderBy("period")),
        "high_frequency": lambda _: F.col(V) - F.avg(V).over(Window.partitionBy("actor").orderBy("period").rowsBetween(-3, 0)),
    }


def transformed(panel: DataFrame, name: str, out: str = "target") -> DataFrame:
    rows = cross_section_rank(panel, "rank__") if name in ("ranks", "normal_quantiles") else panel
    return rows.withColumn(out, target_transforms()[name](rows)).drop("rank__")


# --- mappers: one actor's intensity, by its type -------------------------------------------------------------

Mapper = Callable[[DataFrame], DataFrame]


class MapperRegistry:
    """Actor type -> mapper; a mapper sees the whole cross-section, and the actor is picked out afterwards."""

    def __init__(self):
        rank = lambda p: cross_section_rank(p, "intensity")
        scaled = lambda p: cross_section_minmax(p, "intensity")
        self._mappers: dict[str, Mapper] = dict.fromkeys(("large_firm", "sector_leader", "sme", "bank", "retail_investor", "household"), rank)
        self._mappers |= dict.fromkeys(("global_shock", "central_bank", "regulator", "think_tank", "intl_org", "municipality"), scaled)

    def get(self, actor_type: str) -> Mapper:
        return self._mappers[actor_type]

    def register(self, actor_type: str, mapper: Mapper) -> None:
        self._mappers[actor_type] = mapper

    def registered_types(self) -> list[str]:
        return sorted(self._mappers)

    def intensity(self, panel: DataFrame, actor, actor_type: str) -> DataFrame:
        """(period, intensity) of one actor; KeyError if the panel doesn't have it."""
        mine = self.get(actor_type)(panel).where(F.col("actor") == actor).select("period", "intensity")
        if not mine.take(1):
            raise KeyError(actor)
        return mine

    def mapped(self, panel: DataFrame, kind: str = "actor_type") -> DataFrame:
        """``panel`` with the intensity of every row by the mapper of its ``kind``; null for a kind without one.

        A mapper that several types share runs once, over all actors of the cross-section.
        """
        shared: dict[Mapper, list[str]] = {}
        for actor_type, mapper in self._mappers.items():
            shared.setdefault(mapper, []).append(actor_type)
        out, value = panel, F.lit(None).cast("double")
        for k, (mapper, types) in enumerate(shared.items()):
            out = mapper(out).withColumnRenamed("intensity", f"m{k}__")
            value = F.when(F.col(kind).isin(types), F.col(f"m{k}__")).otherwise(value)
        return out.withColumn("intensity", value).drop(*(f"m{k}__" for k in range(len(shared))))
