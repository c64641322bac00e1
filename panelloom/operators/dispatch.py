"""Intensities of a whole registry: which source and which rule make each actor's values, with fallbacks, and where every value came from."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import order as O
from panelloom.functions import semantics as S

EQUITY = ("large_firm", "sector_leader", "sme", "retail_investor")


@dataclass(frozen=True)
class Rule:
    """One way to an intensity. Of the rules that fit an actor the one with the least ``rank`` counts whose source has values of it.

    ``measure``: level, or growth over ``periods`` quarters. ``scale``: minmax over the actor's time, rank within the quarter.
    ``within`` names registry columns that part a quarter's cross-section. Empty ``layers``, ``types``, ``places`` fit all; ``not_places`` is what doesn't.
    """

    method: str
    source: str
    rank: int
    measure: str = "level"
    scale: str = "rank"
    layers: Sequence[int] = ()
    types: Sequence[str] = ()
    places: Sequence[str] = ()
    not_places: Sequence[str] = ()
    within: Sequence[str] = ()
    periods: int = 4
    filled: bool = True

    def fits(self) -> Column:
        one = lambda c, values: F.col(c).isin(list(values)) if values else F.lit(True)
        # An actor without a place isn't in any that is left out.
        rest = ~F.coalesce(F.col("geography").isin(list(self.not_places)), F.lit(False)) if self.not_places else F.lit(True)
        return one("layer", self.layers) & one("actor_type", self.types) & one("geography", self.places) & rest


#: The order of sources by layer and type: macro series, institutions by news or else their rate, banks by growth, firms by capital spending, outside the home market by return.
RULES = (
    Rule("series_minmax", "series", 1, scale="minmax", layers=(0,)),
    Rule("news_minmax", "news", 1, scale="minmax", layers=(1,), filled=False),
    Rule("rate_minmax", "series", 2, scale="minmax", layers=(1,)),
    Rule("asset_growth_rank", "assets", 1, measure="growth", layers=(2, 3), types=("bank",)),
    Rule("capital_spending_rank", "capex_ratio", 1, types=EQUITY, layers=(2, 3)),
    Rule("return_12m_rank", "prices", 2, measure="growth", types=EQUITY, layers=(2, 3), not_places=("US",), within=("geography",)),
)


def _check(rules: Sequence[Rule]) -> None:
    if len({r.method for r in rules}) < len(rules):
        raise ValueError("two rules have the same method")
    for r in rules:
        if r.measure not in ("level", "growth") or r.scale not in ("rank", "minmax"):
            raise ValueError(f"{r.method}: no such measure or scale")


def eligible(registry: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(actor, geography, sector, layer, actor_type, method, source, rank): a row for each rule that fits an actor; no join."""
    _check(rules)
    fit = [F.when(r.fits(), F.struct(F.lit(r.method).alias("method"), F.lit(r.source).alias("source"), F.lit(r.rank).alias("rank"))) for r in rules]
    return registry.select("actor", "geography", "sector", "layer", "actor_type", F.inline(F.array_compact(F.array(*fit))))


def _measured(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each rule's measure of ``value`` on a complete calendar, as ``measure``."""
    own = Window.partitionBy("actor", "method").orderBy("period")
    filled = F.col("method").isin([r.method for r in rules if r.filled])
    rows = rows.withColumn("value", F.when(filled, F.last("value", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("value")))
    measure = F.col("value")
    for periods in sorted({r.periods for r in rules if r.measure == "growth"}):
        before = F.lag("value", periods).over(own)
        grows = F.col("method").isin([r.method for r in rules if r.measure == "growth" and r.periods == periods])
        measure = F.when(grows, F.when(before != 0, F.col("value") / before - 1)).otherwise(measure)
    return rows.withColumn("measure", measure)


def _scaled(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """With ``intensity``: a rank among the rule's rows of a quarter and pool, or the place between an actor's least and greatest value."""
    pool = F.lit("")
    for within in sorted({tuple(r.within) for r in rules if r.within}):
        methods = [r.method for r in rules if tuple(r.within) == within]
        # Null is a pool of its own; lengths keep two columns' values apart.
        parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in within]
        pool = F.when(F.col("method").isin(methods), F.concat(*parts)).otherwise(pool)
    ranked = F.col("method").isin([r.method for r in rules if r.scale == "rank"])
    # A time series is scaled over all quarters; its rows have the actor for a pool, so that no cross-section holds them.
    rows = rows.withColumn("pool__", F.when(ranked, F.concat(F.lit("q"), pool)).otherwise(F.concat(F.lit("a"), F.col("actor").cast("string"))))
    rows = O.ranked(rows.withColumn("of__", F.when(ranked, F.col("measure"))), {"place__": "of__"}, ["method", "period", "pool__"], share=True)
    span = S.minmax(F.col("measure"), Window.partitionBy("actor", "method"))
    return rows.withColumn("intensity", F.when(ranked, F.col("place__")).otherwise(span)).drop("pool__", "of__", "place__")


def intensities(registry: DataFrame, values: DataFrame, first: dt.date, last: dt.date, rules: Sequence[Rule] = RULES, wins: str = "actor") -> DataFrame:
    """(actor, period, intensity, method, source, rank): one row an actor and quarter from ``first`` to ``last`` (quarters' first days) that has a value.

    ``registry`` has actor, actor_type, layer, geography, sector, one row an actor; ``values`` actor, source, period, value, one row of each. ``wins``: with "actor"
    the best rule with any value of the actor makes all its quarters, with "quarter" the best one that has a value then, so that an actor may have several
    methods. Ranks are taken among those for whom the rule has won, so a fallback's rows never stand in another rule's cross-section.
    """
    if wins not in ("actor", "quarter"):
        raise ValueError("wins is actor or quarter")
    quarters = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 3 months")))
    asked = eligible(registry, rules).withColumn("period", quarters)
    known = values.where(F.col("value").isNotNull()).select("actor", "source", "period", "value")
    rows = _measured(asked.join(known, ["actor", "source", "period"], "left"), rules)
    unit = ["actor"] if wins == "actor" else ["actor", "period"]
    best = F.min(F.when(F.col("measure").isNotNull(), F.col("rank"))).over(Window.partitionBy(*unit))
    won = rows.withColumn("best__", best).where("rank = best__").drop("best__")
    return _scaled(won, rules).where("intensity is not null").select("actor", "period", "intensity", "method", "source", "rank")


def uncovered(registry: DataFrame, found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(actor, actor_type, layer, geography, tried): actors without an intensity, and the sources that their rules name, best first."""
    asked = eligible(registry, rules).groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("t"))  # as many as there are rules
    tried = F.coalesce(F.array_join(F.transform("t", lambda x: x["source"]), ","), F.lit(""))
    missing = registry.join(found.select("actor").distinct(), "actor", "left_anti")
    return missing.join(asked, "actor", "left").select("actor", "actor_type", "layer", "geography", tried.alias("tried"))


def provenance(found: DataFrame) -> DataFrame:
    """(method, source, rank, n_actors, n_quarters, n): what each rule has made."""
    return found.groupBy("method", "source", "rank").agg(F.count_distinct("actor").alias("n_actors"), F.count_distinct("period").alias("n_quarters"), F.count(F.lit(1)).alias("n"))
