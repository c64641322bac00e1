"""Input-output coefficients and news aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import semantics as S


def coefficients(flows: DataFrame, source: str = "source", target: str = "target", flow: str = "flow", by: list[str] | None = None) -> DataFrame:
    """(*by, source, target, coefficient): each source's share of its target's inflow; targets without inflow and zero shares go."""
    by = by or []
    total = flows.groupBy(*by, source, target).agg(F.sum(flow).alias("f__"))
    share = F.col("f__") / F.nullif(F.sum("f__").over(Window.partitionBy(*by, target)), F.lit(0.0))
    return total.withColumn("coefficient", share).where("coefficient > 0").select(*by, source, target, "coefficient")


def pair_means(coefs: DataFrame, labels: DataFrame, key: str, label: str, source: str = "source", target: str = "target") -> DataFrame:
    """(source label, target label, mean): mean coefficient of labelled pairs."""
    a = labels.select(F.col(key).alias(source), F.col(label).alias("source_label"))
    b = labels.select(F.col(key).alias(target), F.col(label).alias("target_label"))
    return coefs.join(a, source).join(b, target).groupBy("source_label", "target_label").agg(F.avg("coefficient").alias("mean"), F.count(F.lit(1)).alias("n"))


def weighted_tone(tone: Column, n: Column) -> Column:
    """Aggregate: mean of tones weighted by counts, where both are known."""
    known = tone.isNotNull() & n.isNotNull()
    return F.try_divide(F.sum(F.when(known, tone * n)), F.nullif(F.sum(F.when(known & (n > 0), n)), F.lit(0)))


def weekly(daily: DataFrame, key: str = "theme", date: str = "event_date") -> DataFrame:
    """Daily (key, date, article_count, avg_tone, total_docs_day) to weeks from Monday: counts add up, tone is weighted, intensity is a ratio of sums."""
    return daily.groupBy(key, S.week(F.col(date)).alias("week_start")).agg(
        F.sum("article_count").alias("article_count"), weighted_tone(F.col("avg_tone"), F.col("article_count")).alias("avg_tone"),
        F.try_divide(F.sum("article_count"), F.sum("total_docs_day")).alias("intensity"),
    )


def daily(docs: DataFrame, baskets: dict[str, list[str]], themes: str = "themes", date: str = "event_date", tone: str = "tone", key: str = "doc_id") -> DataFrame:
    """Documents to (signal, date, article_count, avg_tone, total_docs_day, intensity): a basket matches if it shares a theme. Repeated ids count once."""
    once = docs.dropDuplicates([key])
    total = once.groupBy(date).agg(F.count(F.lit(1)).alias("total_docs_day"))
    hits = F.array_compact(F.array(*(F.when(F.arrays_overlap(themes, F.array(*map(F.lit, words))), F.lit(name)) for name, words in baskets.items())))
    counted = once.withColumn("signal", F.explode(hits)).groupBy("signal", date).agg(F.count(F.lit(1)).alias("article_count"), F.avg(tone).alias("avg_tone"))
    return counted.join(total, date).withColumn("intensity", F.col("article_count") / F.col("total_docs_day"))


def names_any(names: str, aliases: list[str]) -> Column:
    """Does any name in the array contain an alias?"""
    out = F.lit(False)
    for a in aliases:
        out = out | F.exists(names, lambda o, a=a: o.contains(a.lower()))
    return out


def news_quarters(weekly_rows: DataFrame, signal: str, key: str = "actor_id", date: str = "event_date") -> DataFrame:
    """Sum of one signal's values by (actor, quarter). The signal is required: counts, tones and intensities don't add up."""
    return weekly_rows.where(F.col("signal_id") == signal).groupBy(key, S.quarter(F.col(date)).alias("period")).agg(F.sum("value").alias("value"))
