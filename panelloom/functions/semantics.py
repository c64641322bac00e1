"""Guarded windows and min-max rules with exact null and edge behaviour. Ranks and quantile buckets are in ``order``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def rolling(agg, value: Column, frame: WindowSpec, at_least: int) -> Column:
    """``agg(value)`` over ``frame`` where it holds ``at_least`` non-null values, else null."""
    return F.when(F.count(value).over(frame) >= at_least, agg(value).over(frame))


def compound(value: Column, frame: WindowSpec, at_least: int) -> Column:
    """Product of 1 + value, minus 1. A log sum would fail at -100 %, so the frame's few values are multiplied."""
    product = F.aggregate(F.collect_list(value).over(frame), F.lit(1.0), lambda acc, x: acc * (1 + x))
    return F.when(F.count(value).over(frame) >= at_least, product - 1)


def minmax(value: Column, frame: WindowSpec, degenerate: float | None = None, tolerance: float = 0.0) -> Column:
    """(x - min) / (max - min) over ``frame``; ``degenerate`` where the span is at most ``tolerance`` (null: no value)."""
    low, high = F.min(value).over(frame), F.max(value).over(frame)
    flat = F.lit(degenerate).cast("double")
    return F.when(value.isNull(), F.lit(None).cast("double")).when(high - low > tolerance, (value - low) / (high - low)).otherwise(flat)


def zscore(value: Column, frame: WindowSpec, jitter: float = 0.0) -> Column:
    """(x - mean) / (sample deviation + jitter); null without a deviation."""
    return F.try_divide(value - F.avg(value).over(frame), F.stddev_samp(value).over(frame) + jitter)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by the 5-term rational form of Abramowitz and Stegun 26.2.17 (error < 7.5e-8)."""
    # Fixed values of the formula.
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / F.sqrt(F.lit(6.283185307179586)) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def last_known(value: Column, order: Column, *keys: str) -> Column:
    """Aggregate: the last non-null value in ``order`` (ties to the greater value)."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))


def quarter(ts: Column) -> Column:
    return F.date_trunc("quarter", ts).cast("date")


def week(ts: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts).cast("date")
