"""Placebos and random halves from the sums kept by actor and window, so that a draw costs no run over the panel.

A draw is a permutation of the actors' places, computed place by place: swap-or-not rounds (Hoang, Morris and Rogaway 2012) are a bijection of
0 .. n - 1 for any n and need nothing but whole-number arithmetic, done on Arrow batches. So no draw is sorted, joined or held anywhere: each actor's row says on its own which
block it has in a draw, and what is shuffled are sums by (draw, window, block), combined where the rows lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from panelloom.functions import order
from panelloom.operators import forecast
from panelloom.operators.inference import PRIME, drawn
from panelloom.operators.sufficient import SUMS, scores_of

#: Rounds of a permutation; each swaps about half of the pairs that its key makes.
ROUNDS = 32
#: Seeds of the rounds' shifts, of their bits, and of halves.
SHIFT, BIT, HALF = 42, 43, 44
#: The number of the draw that leaves all actors where they are.
REAL = -1


def moved(place: np.ndarray, total: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Where each place of 0 .. total - 1 goes in each draw; whole numbers below 2 ** 63 throughout."""
    draws, at = np.unique(draw, return_inverse=True)
    x = place.astype(np.int64)
    for i in range(ROUNDS):
        shift, key = (_number(draws * 7919 + i * 104_729 + seed)[at] for seed in (SHIFT, BIT))
        partner = (shift - x) % total
        h = (np.maximum(x, partner) % PRIME * 104_729 + key) % PRIME
        x = np.where(h * h % PRIME % 2 == 1, partner, x)
    return x


def _number(a: np.ndarray) -> np.ndarray:
    """``inference.drawn`` on arrays: squares modulo a prime, three times over."""
    a = a % PRIME
    b = (a * a + 12_345) % PRIME
    c = (b * b + a) % PRIME
    return (c * c + b) % PRIME


@F.pandas_udf(LongType())
def permuted(place: pd.Series, total: pd.Series, draw: pd.Series) -> pd.Series:
    """``moved`` as a column. With the rounds as a fold of expressions a thousand draws of 1,000 actors took 32 s, so 14 s, all else included."""
    return pd.Series(moved(place.to_numpy(), total.to_numpy(), draw.to_numpy()))


def placed(members: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(actor, block, *within, place, total, blocks): places from 0 among the actors of ``within``, by block and actor; ``blocks`` tells where each block starts.

    members: (actor, block, *within), one row an actor; a null block is the rest. Actors are numbered range by range, so none of this is in one task.
    """
    within = within or []
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within]
    rows = members.select("actor", "block", *within, F.concat_ws("\x1f", *keys).alias("stratum__"), F.struct("block", "actor").alias("at__"))
    numbered = order.places(rows, "at__", "stratum__").select("stratum__", "at__.actor", "at__.block", F.col("before__").alias("place"), F.col("total__").alias("total"))
    starts = numbered.groupBy("stratum__", "block").agg(F.min("place").alias("start")).groupBy("stratum__").agg(F.array_sort(F.collect_list(F.struct("start", "block"))).alias("blocks"))
    return rows.select("actor", *within, "stratum__").join(numbered.drop("stratum__"), "actor").join(starts, "stratum__").drop("stratum__")


def _by_actor(stats: DataFrame, at: DataFrame) -> DataFrame:
    """An actor's place beside its windows' sums, as one row (as many sums as there are windows).

    Rows are few before they meet the draws, so they are dealt to a fixed number of tasks, which adaptive execution leaves as it is.
    """
    rows = at.join(stats.groupBy("actor").agg(F.collect_list(F.struct("test_year", *SUMS)).alias("sums__")), "actor")
    return rows.repartition(int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")), "actor")


def placebo_scores(stats: DataFrame, members: DataFrame, draws: int, within: list[str] | None = None, fixed: Column | None = None) -> DataFrame:
    """(draw, test_year, n_actors, base_r2, mixed_r2, delta) of ``draws`` permutations of the actors' blocks and of draw -1, the real ones.

    Blocks keep their sizes. ``within``: actors change places only with those alike in these columns; ``fixed``: actors (a condition on members) that keep theirs.
    """
    members = members.withColumn("fixed__", F.coalesce(fixed, F.lit(False)) if fixed is not None else F.lit(False))
    at = placed(members, [*(within or []), "fixed__"])
    dealt = _by_actor(stats, at).withColumn("draw", F.explode(F.sequence(F.lit(REAL), F.lit(draws - 1)).cast("array<long>")))
    # Only places go to the function; whoever stays is given a permutation of one place, which changes nothing.
    stays = (F.col("draw") == REAL) | F.col("fixed__")
    to = permuted(F.when(stays, F.lit(0)).otherwise(F.col("place")), F.when(stays, F.lit(1)).otherwise(F.col("total")), "draw")
    there = dealt.withColumn("to__", to).withColumn("to__", F.when(stays, F.col("place")).otherwise(F.col("to__")))
    rows = there.select(F.col("draw").alias("variant"), F.element_at(F.filter("blocks", lambda b: b["start"] <= F.col("to__")), -1)["block"].alias("block"), F.inline("sums__"))
    return scores_of(rows).withColumnRenamed("variant", "draw")


def placebo_means(scores: DataFrame) -> DataFrame:
    """(draw, n_windows, delta): each draw's mean gain over the windows."""
    return scores.groupBy("draw").agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.avg("delta"), 9).alias("delta"))


def placebo_summary(means: DataFrame) -> DataFrame:
    """(real, mean, sd, z, p, n): the real blocks' gain among the placebos'; ddof 0, p the share of placebos at least as good, null without placebos."""
    real, fake = F.max(F.when(F.col("draw") == REAL, F.col("delta"))), F.when(F.col("draw") != REAL, F.col("delta"))
    g = means.groupBy().agg(real.alias("real"), F.avg(fake).alias("mean"), F.stddev_pop(fake).alias("sd"), F.count(fake).alias("n"), F.array_sort(F.collect_list(fake)).alias("all__"))
    better = F.size(F.filter("all__", lambda x: x >= F.col("real")))
    return g.select("real", "mean", "sd", F.try_divide(F.col("real") - F.col("mean"), F.col("sd")).alias("z"), F.try_divide(better, F.col("n")).alias("p"), "n")


def half_scores(stats: DataFrame, members: DataFrame, splits: int) -> DataFrame:
    """(split, half, test_year, base_r2, mixed_r2): scores of the actors' random halves, each with slopes of its own."""
    dealt = _by_actor(stats, placed(members)).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    half = drawn(F.col("split"), F.col("place"), F.lit(2), HALF)
    rows = dealt.withColumn("half", half.cast("string")).select("split", "half", F.lit("half").alias("variant"), "block", F.inline("sums__"))
    return scores_of(rows, ["split", "half"]).select("split", "half", "test_year", "base_r2", "mixed_r2")


def split_half(stats: DataFrame, members: DataFrame, splits: int, score: str = "mixed_r2") -> DataFrame:
    """(rho, reliability, n) of the block slopes' accuracy (``score``: or base_r2, one slope for all)."""
    return forecast.stepped_up(half_scores(stats, members, splits).withColumnRenamed(score, "r2"))
