"""Sanity of the backtest: noise earns nothing, foresight earns much, momentum doesn't look ahead."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import portfolio as P
from panelloom.operators import signals as G


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(7)
    rows = [(q, a, float(r)) for q in range(24) for a, r in enumerate(rng.normal(0.02, 0.1, 30))]
    return spark.createDataFrame(rows, "quarter int, actor_id long, return_q double")


def sharpe(signal, returns):
    s = P.long_short(P.quintile_sort(signal, returns)).select(F.lit(1).alias("g"), "quarter", F.col("spread").alias("r"))
    return P.performance(s, ["g"]).first()["sharpe"]


def test_foresight_and_noise(returns):
    perfect = returns.select("quarter", "actor_id", F.col("return_q").alias("score"))
    assert sharpe(perfect, returns) > 5
    means = [r["mean"] for r in P.monotonicity(P.quintile_sort(perfect, returns)).orderBy("quintile").collect()]
    assert means == sorted(means) and len(means) == 5
    noise = [sharpe(returns.select("quarter", "actor_id", (F.pmod(F.xxhash64(F.lit(k), "quarter", "actor_id"), F.lit(9973)) / 9973.0).alias("score")), returns) for k in range(6)]
    assert abs(float(np.mean(noise))) < 0.6


def test_momentum_does_not_see_its_own_quarter(returns):
    m = G.momentum(None, returns).join(returns, ["quarter", "actor_id"])
    assert abs(m.select(F.corr("score", "return_q")).first()[0]) < 0.15
    first = G.momentum(None, returns).agg(F.min("quarter")).first()[0]
    assert first == 4


def test_momentum_fixture(spark):
    r = spark.createDataFrame([(q, 1, x) for q, x in enumerate((0.1, 0.2, 0.3, -0.1, 0.4, 0.2))], "quarter int, actor_id long, return_q double")
    assert [round(x["score"], 4) for x in G.momentum(None, r).orderBy("quarter").collect()] == [0.5444, 0.9656]


def test_registries_have_no_gaps():
    assert len(G.SIGNALS) == 14 and not set(G.SIGNALS) & set(G.COMBINATIONS)
