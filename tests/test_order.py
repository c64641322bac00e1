"""Order statistics against pandas, with groups that lie in several ranges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import order as O

SCHEMA = "i long, g string, x double, y double"


def rows(spark, pdf):
    plain = [tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(plain, SCHEMA)


@pytest.fixture(scope="module")
def hot():
    """A group that holds two thirds of all rows, half of them one value; a group of ties, one of nulls, one without a name."""
    rng = np.random.default_rng(5)
    n = 6_000
    g = np.where(rng.random(n) < 0.67, "hot", np.where(rng.random(n) < 0.5, "ties", np.where(rng.random(n) < 0.5, "nulls", None)))
    x = np.exp(rng.normal(0, 4, n))
    x[(g == "hot") & (rng.random(n) < 0.5)] = 0.0
    x[g == "ties"] = rng.integers(-3, 3, (g == "ties").sum())
    x[rng.random(n) < 0.05] = np.nan
    x[g == "nulls"] = np.nan
    return pd.DataFrame({"i": np.arange(n), "g": g, "x": x, "y": np.round(rng.normal(size=n), 2)})


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_equal_pandas(spark, hot, parts):
    got = O.ranked(rows(spark, hot), {"rx": "x", "ry": "y"}, "g", parts=parts, per_range=1).toPandas().sort_values("i")
    share = O.ranked(rows(spark, hot), {"rx": "x"}, ["g"], share=True, parts=parts, per_range=1).toPandas().sort_values("i")
    by = hot.groupby("g", dropna=False)
    assert len(got) == len(share) == len(hot)
    for name, want in (("rx", by["x"].rank()), ("ry", by["y"].rank())):
        assert np.array_equal(got[name].to_numpy(float), want.to_numpy(), equal_nan=True)
    assert np.allclose(share["rx"].to_numpy(float), by["x"].rank(pct=True).to_numpy(), rtol=0, atol=1e-15, equal_nan=True)


@pytest.mark.parametrize("parts", [1, 16])
def test_edges_and_buckets_equal_pandas(spark, hot, parts):
    df = rows(spark, hot)
    edges = {r["g"]: r["edges__"] for r in O.quantile_edges(df, "x", "g", (0.0, 0.1, 0.5, 0.77, 1.0), parts, 50).collect()}
    assert set(edges) == {"hot", "ties", None}
    for g, x in hot.groupby("g", dropna=False)["x"]:
        if x.notna().any():
            want = pd.unique(x.dropna().quantile([0.0, 0.1, 0.5, 0.77, 1.0]))
            assert edges[g if isinstance(g, str) else None] == pytest.approx(list(want), rel=1e-12)
    got = O.quantile_bucket(df, "x", "g", parts=parts, per_range=1).toPandas().sort_values("i")["bucket"].to_numpy(float)
    for g, part in hot.groupby("g", dropna=False):
        x = part["x"]
        want = pd.cut(x, pd.unique(x.quantile(list(O.QUINTILES))), labels=False, include_lowest=True) + 1 if x.notna().any() else x
        assert np.array_equal(got[part["i"]], want.to_numpy(float), equal_nan=True)


def test_one_group_lies_in_several_ranges(spark, hot):
    """No task sorts a whole group: the greatest range has a part of its distinct values, and every range's rows start where those below end."""
    one = rows(spark, hot).where("g = 'hot'")
    p = O.places(one, "x", "g", 16, 1)
    plan = p._jdf.queryExecution().toString()
    assert "range__" in plan and "sort_array" not in plan
    local = p.toPandas().sort_values("x")
    assert local["before__"].tolist() == [0, *local["n__"].cumsum().tolist()[:-1]]
    assert set(local["total__"]) == {local["n__"].sum()} and local["n__"].sum() == one.where("x is not null").count()
    classes = one.where("x is not null").select("x", F.pmod(F.xxhash64("x"), F.lit(16)).alias("c"), F.xxhash64("x").alias("h")).distinct().toPandas()
    cuts = sorted(classes.sort_values("h").groupby("c")["x"].first())
    sizes = np.bincount(np.searchsorted(cuts, local["x"], side="right"), minlength=len(cuts) + 1)
    assert len(cuts) == 16 and sizes.max() < 0.4 * len(local)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert O.ranked(none, {"r": "x"}, "g").collect() == O.quantile_bucket(none, "x", "g").collect() == []
    # A name that is there already is replaced, as withColumn does.
    df = spark.createDataFrame([(1, "a", 3.0, 9.0), (1, "a", 3.0, 9.0), (2, "a", 1.0, 9.0)], SCHEMA)
    assert sorted((r["i"], r["y"]) for r in O.ranked(df, {"y": "x"}, "g").collect()) == [(1, 2.5), (1, 2.5), (2, 1.0)]
