"""AR(1) forecasts with actor means, pooled at any level, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelloom.session import written


def _order() -> WindowSpec:
    return Window.partitionBy("test_year", "actor").orderBy("period")


def deviations(rows: DataFrame) -> DataFrame:
    """Training mean of each actor, and this and the last period's deviation from it."""
    mean = F.coalesce(F.avg(F.when(F.col("train"), F.col("value"))).over(Window.partitionBy("test_year", "actor")), F.lit(0.5))
    return rows.withColumn("mean", mean).withColumn("dev", F.col("value") - F.col("mean")).withColumn("prev", F.lag("dev").over(_order()))


def slope(num: Column, den: Column) -> Column:
    """num / den, 0 where den is next to nothing."""
    return F.when(den > 1e-12, num / den).otherwise(F.lit(0.0))


def _slopes(d: DataFrame, by: list[str]) -> DataFrame:
    known = d.where("train and prev is not null")
    return known.groupBy("test_year", *by).agg(slope(F.sum(F.col("dev") * F.col("prev")), F.sum(F.col("prev") ** 2)).alias("rho"), F.count(F.lit(1)).alias("n"))


def rho(rows: DataFrame, by: list[str]) -> DataFrame:
    """(test_year, *by, rho, n): sum of products of successive deviations over the sum of squares, on training rows."""
    return _slopes(deviations(rows), by)


def rho_correlation(rows: DataFrame) -> DataFrame:
    """(test_year, actor, rho) as the correlation of successive values; 0 where either hardly varies."""
    d = rows.where("train").withColumn("before", F.lag("value").over(_order())).where("before is not null")
    good = (F.stddev_pop("value") > 1e-10) & (F.stddev_pop("before") > 1e-10)
    return d.groupBy("test_year", "actor").agg(F.when(good, F.corr("before", "value")).otherwise(F.lit(0.0)).alias("rho"))


def rho_error(rows: DataFrame, by: list[str]) -> DataFrame:
    """(test_year, *by, rho, se): the slope's standard error, from n - 2 degrees of freedom."""
    d = deviations(rows).where("train and prev is not null").join(rho(rows, by), ["test_year", *by])
    error = F.sum((F.col("dev") - F.col("rho") * F.col("prev")) ** 2)
    n = F.count(F.lit(1))
    return d.groupBy("test_year", *by).agg(F.first("rho").alias("rho"), F.when((n > 2) & (F.sum(F.col("prev") ** 2) > 1e-12), F.sqrt(error / ((n - 2) * F.sum(F.col("prev") ** 2)))).alias("se"))


def forecasts(rows: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """``rows`` of the test years with a one-step forecast for each name in ``levels``, its slope pooled by those columns.

    mean + rho * last deviation, estimates frozen at the year's start. Deviations are written once for all levels;
    slopes are aggregates, small next to the rows that they are joined to.
    """
    d = written(deviations(rows))
    out = d.where(~F.col("train"))
    for name, by in levels.items():
        s = _slopes(d, by).select("test_year", *by, F.col("rho").alias("rho__"))
        out = out.join(s, ["test_year", *by]).withColumn(name, F.col("mean") + F.col("rho__") * F.coalesce("prev", F.lit(0.0))).drop("rho__")
    return out.select(*rows.columns, *levels)


def ewm_mean(rows: DataFrame, half_life: float = 12.0) -> DataFrame:
    """(test_year, actor, ewm): mean of training values, each weighted 0.5 ** (age / half_life)."""
    age = F.row_number().over(Window.partitionBy("test_year", "actor").orderBy(F.col("period").desc())) - 1
    w = rows.where("train").withColumn("w", F.pow(F.lit(0.5), age / F.lit(half_life)))
    return w.groupBy("test_year", "actor").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("ewm"))
