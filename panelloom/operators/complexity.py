"""Compression distance between cross-sections, and the gate that it gives."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def distance_of(x: bytes, y: bytes) -> float:
    """Normalised compression distance at level 9."""
    a, b, both = (len(gzip.compress(z, compresslevel=9)) for z in (x, y, x + y))
    return (both - min(a, b)) / max(a, b)


@pandas_udf(DoubleType())
def compression_distance(x: pd.Series, y: pd.Series) -> pd.Series:
    """Of each pair of byte strings; null where one is."""
    return pd.Series([None if a is None or b is None else distance_of(bytes(a), bytes(b)) for a, b in zip(x, y, strict=True)], dtype="Float64")


def tercile_bytes(panel: DataFrame, by: list[str], value: str = "value", actor: str = "actor") -> DataFrame:
    """(*by, codes): a cross-section's values as a byte each, in the actors' order: 0, 1 above the 33.3rd and 2 above the 66.7th percentile.

    Percentiles are merged from counts of values; what is gathered is a byte an actor.
    """
    rows = panel.where(F.col(value).isNotNull())
    cuts = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.333), F.lit(0.667))).alias("cuts__"))
    code = F.when(F.col(value) > F.col("cuts__")[1], "02").when(F.col(value) > F.col("cuts__")[0], "01").otherwise("00")
    coded = rows.join(cuts, by).select(*by, F.struct(actor, code.alias("code")).alias("c"))
    return coded.groupBy(*by).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["code"]), "")).alias("codes"))


def successive_distances(panel: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """(*by, order, ncd): each cross-section's distance from the one before; null for the first."""
    codes = tercile_bytes(panel, [*by, order], value)
    before = F.lag("codes").over(Window.partitionBy(*by).orderBy(order))
    return codes.withColumn("before__", before).select(*by, order, compression_distance("before__", "codes").alias("ncd"))


def gate(distances: DataFrame, by: list[str], order: str) -> DataFrame:
    """(*by, order, policy, open): open where the distance known before (one row earlier) is below the median of those known earlier still, or there are none.

    As rows of ``forecast.gates``: the two can be put together for ``forecast.gated``.
    """
    seq = Window.partitionBy(*by).orderBy(order)
    known = distances.withColumn("known__", F.lag("ncd").over(seq))
    middle = F.percentile("known__", F.lit(0.5)).over(seq.rowsBetween(Window.unboundedPreceding, -1))
    return known.select(*by, order, F.lit("ncd").alias("policy"), F.coalesce(F.col("known__") < middle, F.lit(True)).alias("open"))
