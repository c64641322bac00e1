"""Order statistics of groups of any size: average ranks, quantile edges and buckets.

Rows are counted by distinct value before anything is shuffled by order. A group's values are then cut at splitters, which
are the values of least hash in each of ``parts`` hash classes: a random choice that doesn't hang on the order of execution,
so a task that is run again cuts alike. A group has a splitter for each ``per_range`` distinct values, up to ``parts``, so what a task
sorts is one range of a group, about one in ``parts`` of a large group's distinct values; how many rows lie below a range is a sum over at most ``parts`` + 1 rows a group.

Ranks go back to their rows by value. Values that are sums of floating-point numbers may differ in the last digit when they
are computed again, so the rows are written to the shared folder once and read by all branches.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import written

#: Most splitters of a group.
PARTS = 64
#: Distinct values for which a group gets a splitter.
PER_RANGE = 10_000
#: The probabilities of five buckets as i * 0.2 adds up in floating point; .6 is not the literal.
QUINTILES = tuple(i * 0.2 for i in range(6))

Names = str | list[str]


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, nulls alike."""
    right = right.withColumnsRenamed({k: f"{k}__right" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}__right")) for k in keys))
    return left.join(right, same, "left").drop(*(f"{k}__right" for k in keys))


def _attach_group(rows: DataFrame, groups: DataFrame, value: str, keys: list[str], parts: int) -> DataFrame:
    """One row a group joined to the group's rows; ``groups`` is copied ``parts`` times, so that no task gets a whole group."""
    copies = groups.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _attach(rows.withColumn("salt__", _salt(value, parts)), copies, [*keys, "salt__"]).drop("salt__")


def _salt(value: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def places(rows: DataFrame, value: str, by: Names, parts: int = PARTS, per_range: int = PER_RANGE) -> DataFrame:
    """(*by, value, n__, before__, total__): each distinct value that isn't null, with the rows that have it, those of less and all of its group."""
    keys = _list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n__"))
    # The count is carried along only for both branches to read one shuffle.
    least = F.min(F.struct(F.xxhash64(value).alias("hash"), F.col(value).alias("cut"), F.col("n__").alias("n")))
    classes = counts.groupBy(*keys, _salt(value, parts).alias("class__")).agg(least.alias("least__"), F.count(F.lit(1)).alias("values__"))
    cuts = classes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("class__", "least__.cut"))).alias("cuts__"), F.sum("values__").alias("values__"))
    few = F.slice("cuts__", F.lit(1), F.least(F.lit(parts), F.floor(F.col("values__") / F.lit(per_range))).cast("int"))
    cuts = cuts.select(*keys, F.transform(few, lambda c: c["cut"]).alias("cuts__"))
    cut = _attach_group(counts, cuts, value, keys, parts).withColumn("range__", F.size(F.filter("cuts__", lambda c: c <= F.col(value)))).drop("cuts__")
    ranges, group = Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "range__").agg(F.sum("n__").alias("m__")).select(*keys, "range__", F.coalesce(F.sum("m__").over(ranges), F.lit(0)).alias("below__"), F.sum("m__").over(group).alias("total__"))
    inside = Window.partitionBy(*keys, "range__").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    told = _attach(cut.withColumn("inside__", F.coalesce(F.sum("n__").over(inside), F.lit(0))), sums, [*keys, "range__"])
    return told.select(*keys, value, "n__", (F.col("below__") + F.col("inside__")).alias("before__"), "total__")


def ranked(df: DataFrame, values: dict[str, str], by: Names, share: bool = False, parts: int = PARTS, per_range: int = PER_RANGE) -> DataFrame:
    """``df`` with the average rank within ``by`` of each column of ``values`` (new name -> column), from 1; null stays null.

    Tied values share the mean of their places, unlike in percent_rank or cume_dist. ``share``: over the count of non-null values.
    Null keys are a group of their own. ``by`` doesn't hold a ranked column.
    """
    rows = out = written(df)
    for k, value in enumerate(values.values()):
        rank = F.col("before__") + (F.col("n__") + 1) / 2
        table = places(rows, value, by, parts, per_range).select(*_list(by), value, (rank / F.col("total__") if share else rank).alias(f"rank{k}__"))
        out = _attach(out, table, [*_list(by), value])
    return out.withColumns({name: F.col(f"rank{k}__") for k, name in enumerate(values)}).drop(*(f"rank{k}__" for k in range(len(values))))


def quantile_edges(rows: DataFrame, value: str, by: Names, probabilities: tuple[float, ...] = QUINTILES, parts: int = PARTS, per_range: int = PER_RANGE) -> DataFrame:
    """(*by, edges__): linearly interpolated quantiles of the values that aren't null, repeated edges dropped."""
    before, total = F.col("before__"), F.col("total__")

    def edge(p: float) -> Column:
        at = lambda n: (n - 1) * F.lit(p)
        holds = lambda place: (before <= place) & (place < before + F.col("n__"))
        low, high = (F.max(F.when(holds(F.least(F.floor(at(total)) + k, total - 1)), F.col(value))) for k in (0, 1))
        return low + (high - low) * (at(F.max(total)) - F.floor(at(F.max(total))))

    return places(rows, value, by, parts, per_range).groupBy(*_list(by)).agg(F.array_distinct(F.array(*(edge(p) for p in probabilities))).alias("edges__"))


def quantile_bucket(df: DataFrame, value: str, by: Names, name: str = "bucket", probabilities: tuple[float, ...] = QUINTILES, parts: int = PARTS, per_range: int = PER_RANGE) -> DataFrame:
    """Right-closed quantile buckets from 1 within ``by``; tied edges merge, so there can be fewer buckets."""
    rows = written(df)
    told = _attach_group(rows, quantile_edges(rows, value, by, probabilities, parts, per_range), value, _list(by), parts)
    below = F.size(F.filter("edges__", lambda e: e < F.col(value)))
    return told.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(F.lit(1), below))).drop("edges__")
