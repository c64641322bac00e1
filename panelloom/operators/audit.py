"""Coverage, gaps and quality of panels and observation stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(rows: DataFrame, by: list[str], date: str, value: str, expected_quarters: int, since: str | None = None, enough: int = 56) -> DataFrame:
    """(*by, n_obs, first_obs, last_obs, n_quarters, coverage_pct, enough): non-null values and distinct quarters."""
    x = rows.where(F.col(value).isNotNull())
    if since:
        x = x.where(F.col(date) >= F.lit(since).cast("date"))
    q = F.count_distinct(F.date_trunc("quarter", F.col(date)))
    return x.groupBy(*by).agg(F.count(value).alias("n_obs"), F.min(date).cast("date").alias("first_obs"), F.max(date).cast("date").alias("last_obs"), q.alias("n_quarters"), (100 * q / expected_quarters).alias("coverage_pct"), (q >= enough).alias("enough"))


def span_class(first: Column, last: Column) -> Column:
    """Regime class by years between two dates: 15, 10, 5."""
    years = F.datediff(last, first) / F.lit(365.25)
    return F.when(years >= 15, "long").when(years >= 10, "medium").when(years >= 5, "short").otherwise("insufficient")


def date_gaps(rows: DataFrame, by: list[str], date: str, more_than: int = 100) -> DataFrame:
    """(*by, from, to, days): successive dates more than so many days apart."""
    days = rows.select(*by, F.col(date).cast("date").alias("to")).distinct()
    before = F.lag("to").over(Window.partitionBy(*by).orderBy("to"))
    return days.withColumn("from", before).withColumn("days", F.datediff("to", "from")).where(F.col("days") > more_than).select(*by, "from", "to", "days")


def missing_weeks(rows: DataFrame, by: list[str], date: str, at_least: int = 4) -> DataFrame:
    """(*by, first, last, weeks): runs of weeks without a row, within each group's own span.

    Runs come from neighbouring weeks that have rows, so no calendar is laid out.
    """
    weeks = rows.select(*by, F.date_trunc("week", F.col(date)).cast("date").alias("w")).distinct()
    before = F.lag("w").over(Window.partitionBy(*by).orderBy("w"))
    gap = weeks.withColumn("b", before).withColumn("weeks", (F.datediff("w", "b") / 7).cast("int") - 1).where(F.col("weeks") >= at_least)
    return gap.select(*by, F.date_add("b", 7).alias("first"), F.date_add("w", -7).alias("last"), "weeks")


def coverage_matrix(rows: DataFrame, row: str, column: str, date: str, stale_before: int) -> DataFrame:
    """Every (row, column) pair: n, first and last year, stale. Pairs without rows have n = 0."""
    seen = rows.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"), F.min(F.year(date)).alias("first_year"), F.max(F.year(date)).alias("last_year"))
    pairs = rows.select(row).distinct().crossJoin(rows.select(column).distinct())  # a report's labels
    return pairs.join(seen, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("stale", F.coalesce(F.col("last_year") < stale_before, F.lit(True)))


def distribution(panel: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(*by, n, missing_pct, mean, sd, skew, out_of_range): skewness corrected for bias, range [0, 1] with 1e-9 to spare."""
    n = F.count(value)
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    out = F.count_if((F.col(value) < -1e-9) | (F.col(value) > 1 + 1e-9))
    return panel.groupBy(*by).agg(n.alias("n"), (100 * (1 - n / F.count(F.lit(1)))).alias("missing_pct"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), skew.alias("skew"), out.alias("out_of_range"))


def feasibility(cover: DataFrame, unit: str, source: str, quarters: str, full: int = 56, partial: int = 40, scale_to: int = 600) -> DataFrame:
    """(n_units, n_full, n_partial, projected, verdict): each unit by its best source, extrapolated to ``scale_to`` units."""
    best = cover.groupBy(unit).agg(F.max(quarters).alias("q"), F.max_by(source, F.struct(quarters, source)).alias("source"))
    a = best.agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("q") >= full).alias("n_full"), F.count_if((F.col("q") >= partial) & (F.col("q") < full)).alias("n_partial"))
    share = F.col("n_full") / F.col("n_units")
    verdict = F.when(share >= 0.5, "PASS").when(share >= 0.25, "PIVOT_A").when((F.col("n_full") + F.col("n_partial")) / F.col("n_units") >= 0.25, "PIVOT_B").otherwise("KILL")
    return a.withColumn("projected", F.round(share * scale_to).cast("long")).withColumn("verdict", verdict)


def thin_layers(registry: DataFrame, at_least: int = 2, exempt: int = 0, kind: str = "actor_type") -> DataFrame:
    """(layer, kinds): layers with too few kinds of actors; the exempt one never is."""
    return registry.groupBy("layer").agg(F.count_distinct(kind).alias("kinds")).where((F.col("kinds") < at_least) & (F.col("layer") != exempt))


def presence(wide_days: DataFrame, unit: str, date: str, value: str, sparse_below: float = 0.5) -> DataFrame:
    """(unit, days, share, sparse): days with a value over all distinct days."""
    total = wide_days.select(F.count_distinct(F.col(date)).alias("all_days"))
    held = wide_days.where(F.col(value).isNotNull()).groupBy(unit).agg(F.count_distinct(date).alias("days"))
    out = held.crossJoin(F.broadcast(total)).withColumn("share", F.col("days") / F.col("all_days"))
    return out.select(unit, "days", "share", (F.col("share") < sparse_below).alias("sparse"))
