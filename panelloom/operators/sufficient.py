"""Forecast scores of any partition into blocks from sums kept by actor and window.

A slope by block, its forecasts and their R2 depend on the panel through a few sums of products, and those add up over actors. They are taken
once; dropping actors, moving them or drawing other blocks is then an aggregate over (window, actor) rows instead of a run over the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import autoregression as ar
from panelloom.operators import scoring, windows

SUMS = ["n", "xx", "xy", "m", "pp", "py", "yy", "total", "inner", "square"]


def statistics(rows: DataFrame) -> DataFrame:
    """(test_year, actor, *SUMS) of estimation windows.

    n, xx, xy: training rows with a row before, sums of the deviation before squared and times the deviation. m, pp, py, yy: test rows and
    their sums, a missing deviation before as 0. total, inner, square: the test values' sum, their squares about the actor's mean, total squared over m.
    """
    train, test = F.col("train") & F.col("prev").isNotNull(), ~F.col("train")
    prev = F.coalesce("prev", F.lit(0.0))
    of = lambda where, x: F.coalesce(F.sum(F.when(where, x)), F.lit(0.0))
    values = F.when(test, F.col("value"))
    g = ar.deviations(rows).groupBy("test_year", "actor").agg(
        F.count_if(train).alias("n"), of(train, F.col("prev") ** 2).alias("xx"), of(train, F.col("prev") * F.col("dev")).alias("xy"),
        F.count_if(test).alias("m"), of(test, prev * prev).alias("pp"), of(test, prev * F.col("dev")).alias("py"), of(test, F.col("dev") ** 2).alias("yy"),
        F.coalesce(F.sum(values), F.lit(0.0)).alias("total"), F.coalesce(F.var_pop(values) * F.count(values), F.lit(0.0)).alias("inner"),
    )
    return g.withColumn("square", F.when(F.col("m") > 0, F.col("total") ** 2 / F.col("m")).otherwise(0.0))


def statistics_of_panels(panels: DataFrame, test_years: list[int], years: int) -> DataFrame:
    """(panel, test_year, actor, *SUMS) of many versions of a panel (panel, actor, period, value) in one run: a version's actors are actors of their own."""
    keyed = panels.select(F.struct("panel", "actor").alias("actor"), "period", "value")
    s = statistics(windows.windows(keyed, test_years, years))
    return s.select("actor.panel", "test_year", F.col("actor.actor").alias("actor"), *SUMS)


def membership(registry: DataFrame, variants: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """(variant, actor, block): for each variant the actors that are there (all, if None) and their blocks; null: no block of its own. No join."""
    rows = [F.struct(F.lit(name).alias("variant"), block.cast("string").alias("block"), (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there")) for name, (block, there) in variants.items()]
    return registry.select("actor", F.inline(F.array(*rows))).where("there").select("variant", "actor", "block")


def scores(stats: DataFrame, members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, variant, test_year, n_actors, base_r2, mixed_r2, delta): one slope for all, against slopes of their own for the blocks and that one for the rest.

    The slope for all is over the variant's actors, those in blocks too. R2 is about the mean of all test values, 0 if they are equal. One join of
    (window, actor) rows with the variants, then a row a block.
    """
    return scores_of(stats.join(members, "actor"), by)


def scores_of(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same of rows (*by, variant, test_year, block, *SUMS) that are joined already, one an actor. What is shuffled are sums a block."""
    by = by or []
    keys = [*by, "variant", "test_year"]
    g = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("actors"), *(F.sum(c).alias(c) for c in SUMS))
    all_ = Window.partitionBy(*keys)
    base = ar.slope(F.sum("xy").over(all_), F.sum("xx").over(all_))
    g = g.withColumn("base", base).withColumn("own", F.when(F.col("block").isNotNull(), ar.slope(F.col("xy"), F.col("xx"))).otherwise(F.col("base")))
    miss = lambda r: F.sum(F.col("yy") - 2 * F.col(r) * F.col("py") + F.col(r) ** 2 * F.col("pp"))
    spread = F.sum("inner") + F.sum("square") - F.sum("total") ** 2 / F.sum("m")
    r2 = lambda r: F.when(spread > 1e-15, 1 - miss(r) / spread).otherwise(0.0)
    out = g.groupBy(*keys).agg(F.sum("actors").alias("n_actors"), r2("base").alias("base_r2"), r2("own").alias("mixed_r2"))
    return out.withColumn("delta", F.col("mixed_r2") - F.col("base_r2"))


def summary(found: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, mean, t, p, base_r2, mixed_r2, wins) over the windows: mean gain, its t and two-sided p, mean R2, and windows with a gain."""
    means = found.groupBy(*by).agg(F.avg("base_r2").alias("base_r2"), F.avg("mixed_r2").alias("mixed_r2"), F.count_if(F.col("delta") > 0).alias("wins"))
    return scoring.paired_t(found, by).join(means, by)


def merged_gain(found: DataFrame, first: str, second: str, both: str, by: list[str] | None = None, least: float = 0.005) -> DataFrame:
    """(*by, n, first, second, parts, merged, excess, finding): does one block of two gain more than the two as blocks of their own?

    Mean gains of three variants over the windows that all have. A block has one slope in each, so nothing but the pooling differs. finding:
    shared where the merged gain exceeds the parts' sum by ``least``, apart where it falls short by as much, else unclear.
    """
    by = by or []
    wide = found.groupBy(*by, "test_year").agg(*(F.max(F.when(F.col("variant") == v, F.col("delta"))).alias(f"{k}__") for k, v in (("a", first), ("b", second), ("m", both))))
    g = wide.where("a__ is not null and b__ is not null and m__ is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("a__").alias("first"), F.avg("b__").alias("second"), F.avg("m__").alias("merged"))
    g = g.withColumn("parts", F.col("first") + F.col("second")).withColumn("excess", F.col("merged") - F.col("parts"))
    return g.withColumn("finding", F.when(F.col("excess") > least, "shared").when(F.col("excess") < -least, "apart").otherwise("unclear"))
