"""Actor registries and universes: layers, quotas, top lists, de-duplication and capped selection."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.schema import ACTOR, assert_columns


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry JSON ({..., "actors": [...]}) to (position, actor columns); ValueError without actors."""
    raw = assert_columns(spark.read.json(path, multiLine=True), ["actors"])
    actors = raw.select(F.posexplode(F.from_json(F.to_json("actors"), f"array<{ACTOR.simpleString()}>")).alias("position", "a"))
    return actors.select("position", "a.*")


def write_registry(actors: DataFrame, path: str, **metadata) -> None:
    """The registry as one JSON object with its metadata, written by Spark to any file system: ``path`` is a folder with one part.

    A registry is a few hundred rows, which meet in one value.
    """
    one = F.struct("position", F.to_json(F.struct(*(c for c in actors.columns if c != "position"))).alias("a"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["a"]), ", ")
    head = json.dumps({**metadata, "actors": []}).removesuffix("]}")
    actors.agg(F.concat(F.lit(head), listed, F.lit("]}")).alias("value")).write.mode("overwrite").text(path)


def taxonomy_actors(markdown: str) -> list[dict[str, str]]:
    """Actors of the first yaml block of a taxonomy document: a flat list of maps under the key actors."""
    block = re.search(r"```yaml\s*\n(.*?)```", markdown, re.DOTALL)
    if not block or not re.search(r"(?m)^actors:\s*$", block[1]):
        raise ValueError("no yaml block with actors")
    out: list[dict[str, str]] = []
    for line in block[1].split("\n"):
        m = re.match(r"\s*(- )?\s*([A-Za-z_]+):\s*(.+?)\s*$", line)
        if m:
            if m[1]:
                out.append({})
            if out:
                out[-1][m[2]] = m[3].strip("'\"")
    return out


def in_layer(registry: DataFrame, layer: int) -> DataFrame:
    return registry.where(F.col("layer") == layer)


def of_type(registry: DataFrame, actor_type: str) -> DataFrame:
    return registry.where(F.col("actor_type") == actor_type)


def first_wins(parts: Iterable[DataFrame], key: str = "actor") -> DataFrame:
    """Union in order of priority; of each key the first part's row stays (ties within a part: by size, then name)."""
    out = None
    for k, part in enumerate(parts):
        one = part.withColumn("part__", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("part__", *[F.col(c).asc_nulls_last() for c in ("name",) if c in out.columns])
    return out.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__", "part__")


def top_per_group(df: DataFrame, group: str | None, order: Column, tie: str, n: int) -> DataFrame:
    """The n first rows by ``order`` (of each group), ties by ``tie``."""
    if group is None:
        return df.orderBy(order, tie).limit(n)
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(group).orderBy(order, tie))).where(F.col("n__") <= n).drop("n__")


def rank_in_sector(df: DataFrame, sector: str = "sector", position: str = "position", leaders: int = 2) -> DataFrame:
    """Place of each row within its sector from 0, and whether it leads: the first ``leaders`` do."""
    w = Window.partitionBy(sector).orderBy(position)
    return df.withColumn("sector_rank", F.row_number().over(w) - 1).withColumn("leader", F.col("sector_rank") < leaders)


def layer_type(sector: Column, sector_rank: Column, share: Column) -> Column:
    """Type of a listed firm: banks by sector, leaders by place in the sector, the upper 60 % by size large, the rest small."""
    return F.when(F.lower(sector).contains("financ"), "bank").when(sector_rank < 2, "sector_leader").when(share <= 0.6, "large_firm").otherwise("sme")


def one_per_share_class(df: DataFrame, isin: str, order: list[Column]) -> DataFrame:
    """Of each ISIN the first row in ``order``; rows without one all stay."""
    w = Window.partitionBy(isin).orderBy(*order)
    kept = df.where(F.col(isin).isNotNull()).withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")
    return kept.unionByName(df.where(F.col(isin).isNull()))


def quotas(df: DataFrame, group: str, n: int) -> DataFrame:
    """(group, size, quota): at least 1 each, in proportion, the largest group adjusted so that quotas sum to n."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    all_ = Window.partitionBy(F.lit(1))  # one row a group
    q = g.withColumn("q", F.greatest(F.lit(1), F.bround(n * F.col("size") / F.sum("size").over(all_)).cast("long")))
    place = F.row_number().over(all_.orderBy(F.col("size").desc(), group))
    return q.withColumn("quota", F.when(place == 1, F.col("q") + n - F.sum("q").over(all_)).otherwise(F.col("q"))).select(group, "size", "quota")


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly each group's quota of rows, drawn by a seeded hash order: the same rows on any cluster."""
    q = quotas(df, group, n)
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.join(q.select(group, "quota"), group).withColumn("n__", F.row_number().over(w)).where("n__ <= quota").drop("n__", "quota")


def shuffled(keys: list[str], seed: int = 42) -> list[str]:
    """Keys in the order that Python's generator draws them, for parity with drivers that sample in Python."""
    out = sorted(keys)
    random.Random(seed).shuffle(out)
    return out


def capped_selection(firms: DataFrame, n: int, order: list[str], caps: dict[str, float], key: str = "actor") -> DataFrame:
    """Greedy choice of n firms in ``order``: none that lifts its group over a cap (share of n) of any column in ``caps``.

    If the caps leave fewer than n, the first of those passed over fill up. Each choice depends on all before, so a universe (some
    thousand candidates) is one ordered group.
    """
    columns = [key, *order, *caps]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, key], kind="stable")
        held: dict[tuple[str, object], int] = {}
        taken, passed = [], []
        for i, row in zip(pdf.index, pdf[list(caps)].itertuples(index=False), strict=True):
            groups = list(zip(caps, row, strict=True))
            if len(taken) < n and all(held.get(g, 0) + 1 <= max(1, int(caps[g[0]] * n)) for g in groups):
                taken.append(i)
                for g in groups:
                    held[g] = held.get(g, 0) + 1
            else:
                passed.append(i)
        filled = passed[: max(0, n - len(taken))]
        return pd.DataFrame({key: pdf.loc[taken + filled, key], "place": range(1, len(taken) + len(filled) + 1), "filled": [False] * len(taken) + [True] * len(filled)})

    kind = firms.schema[key].dataType.simpleString()
    return firms.select(*dict.fromkeys(columns)).groupBy(F.lit(1).alias("all__")).applyInPandas(choose, f"{key} {kind}, place int, filled boolean")
