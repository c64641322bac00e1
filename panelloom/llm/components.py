"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import dealt_anew, stored


def _starred(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all v of u as m.

    The least value is aggregated map-side and joined back, so a vertex with very many neighbours is
    never gathered, and the join's hot partition is one that adaptive execution can split (see dealt_anew).
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(dealt_anew(least, "u"), "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (columns a, b: long); the component is its smallest node.

    Self-loops and repeated edges do no harm; an empty table gives an empty one. ``max_rounds`` bounds the
    loop against a bug only: the number of rounds grows with the logarithm of the longest path, and
    reaching the bound is an error rather than a cut result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _starred(large)
        now = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
