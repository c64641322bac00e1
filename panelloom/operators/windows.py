"""Rolling estimation windows: the panel's rows dealt to every test year whose window holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(panel: DataFrame, test_years: list[int], years: int = 5, impute: str = "full", least_actors: int = 5, least_rows: int = 4) -> DataFrame:
    """(test_year, actor, period, value, train): complete grids of ``years`` training years and the test year.

    Actors without any value in a window leave it. Gaps get the actor's mean over the whole window, test year included
    (``impute`` "full", as the reference results were made), or over its training rows ("train", which doesn't look ahead). Windows
    with fewer than ``least_actors`` actors or ``least_rows`` training periods are dropped.
    """
    if impute not in ("full", "train"):
        raise ValueError("impute is full or train")
    clean = panel.where("actor is not null and period is not null").groupBy("actor", "period").agg(F.avg("value").alias("value"))
    tests = F.array(*(F.lit(int(y)) for y in sorted(test_years)))
    seen = clean.groupBy("period").agg(F.count(F.lit(1))).select("period", F.year("period").alias("year"))
    dealt = seen.withColumn("test_year", F.explode(F.filter(tests, lambda y: (F.col("year") <= y) & (F.col("year") >= y - years))))
    grid = dealt.groupBy("test_year").agg(F.array_sort(F.collect_list(F.struct("period", (F.col("year") < F.col("test_year")).alias("train")))).alias("grid"))
    # An actor's quarters meet once; all windows are cut from them where they lie.
    own = clean.groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("has")).crossJoin(F.broadcast(grid))  # grid: one row a year
    cells = own.select("test_year", "actor", F.transform("grid", lambda g: F.struct(g["period"].alias("period"), F.try_element_at("has", g["period"]).alias("value"), g["train"].alias("train"))).alias("cells"))
    cells = cells.where(F.exists("cells", lambda c: c["value"].isNotNull()))
    known = F.filter("cells", lambda c: c["value"].isNotNull() if impute == "full" else c["value"].isNotNull() & c["train"])
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, c: s + c["value"]), F.size(known))
    n_rows = F.size(F.filter("cells", lambda c: c["train"]))
    good = cells.groupBy("test_year").agg(F.count(F.lit(1)).alias("n_actors"), F.max(n_rows).alias("n_rows")).where((F.col("n_actors") >= least_actors) & (F.col("n_rows") >= least_rows)).select("test_year")
    full = cells.join(F.broadcast(good), "test_year", "left_semi").select("test_year", "actor", mean.alias("fill__"), F.inline("cells"))  # good: one row a year
    return full.select("test_year", "actor", "period", F.coalesce("value", "fill__", F.lit(0.5)).alias("value"), "train")


def with_blocks(rows: DataFrame, blocks: DataFrame, remainder: str = "REMAINDER") -> DataFrame:
    """``rows`` with the actor's block; actors in none are in ``remainder``. ``blocks``: (actor, block), one a actor."""
    return rows.join(blocks.select("actor", "block"), "actor", "left").withColumn("block", F.coalesce("block", F.lit(remainder)))
