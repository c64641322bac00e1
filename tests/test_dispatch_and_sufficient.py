from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelloom.operators import autoregression as ar
from panelloom.operators import dispatch, scoring, sufficient, windows
from panelloom.operators.dispatch import Rule

Q = [dt.date(2000 + k // 4, 3 * (k % 4) + 1, 1) for k in range(8)]


def registry(spark, rows):
    return spark.createDataFrame(rows, "actor long, actor_type string, layer int, geography string, sector string")


def values(spark, rows):
    return spark.createDataFrame([(a, s, Q[k], v) for a, s, k, v in rows], "actor long, source string, period date, value double")


def found(df):
    return {(r["actor"], Q.index(r["period"])): (round(r["intensity"], 6), r["method"]) for r in df.collect()}


ACTORS = [(1, "large_firm", 2, "US", "a"), (2, "large_firm", 2, "UK", "a"), (3, "large_firm", 2, "UK", "b"), (4, "large_firm", 2, None, "b"), (5, "bank", 3, "US", "b"), (6, "municipality", 2, "UK", "b"), (7, "global_shock", 0, None, None)]


def test_fallbacks_and_their_pools(spark):
    """Firms at home have no fallback; others are ranked within their country, one without a country in a pool of its own."""
    prices = [(a, "prices", k, 100.0 + a * k) for a in (1, 2, 3, 4) for k in range(8)]
    v = values(spark, prices + [(2, "capex_ratio", 3, 0.2), (5, "assets", 0, 10.0), (5, "assets", 4, 15.0), (7, "series", 0, 1.0), (7, "series", 2, 3.0)])
    got = found(dispatch.intensities(registry(spark, ACTORS), v, Q[0], Q[-1]))
    assert {a for a, _ in got} == {2, 3, 4, 5, 7}
    assert {k: x for k, x in got.items() if k[0] == 2} == {(2, k): (1.0, "capital_spending_rank") for k in range(3, 8)}
    assert all(got[a, k] == (1.0, "return_12m_rank") for a in (3, 4) for k in range(4, 8)) and (3, 3) not in got
    assert {k: x for (a, k), x in got.items() if a == 5} == {k: (1.0, "asset_growth_rank") for k in range(4, 8)}
    assert [got[7, k][0] for k in range(4)] == [0.0, 0.0, 1.0, 1.0]
    missing = {r["actor"]: r["tried"] for r in dispatch.uncovered(registry(spark, ACTORS), dispatch.intensities(registry(spark, ACTORS), v, Q[0], Q[-1])).collect()}
    assert missing == {1: "capex_ratio", 6: ""}


def test_best_source_of_each_quarter(spark):
    rules = [Rule("first", "x", 1, filled=False), Rule("second", "y", 2, filled=False)]
    v = values(spark, [(1, "x", 0, 1.0), (1, "y", 0, 9.0), (1, "y", 1, 9.0), (2, "x", 0, 2.0), (2, "x", 1, None), (3, "y", 1, 1.0)])
    actors = registry(spark, [(a, "bank", 2, "US", "s") for a in (1, 2, 3)])
    by_quarter = found(dispatch.intensities(actors, v, Q[0], Q[1], rules, wins="quarter"))
    assert by_quarter == {(1, 0): (0.5, "first"), (2, 0): (1.0, "first"), (1, 1): (1.0, "second"), (3, 1): (0.5, "second")}
    by_actor = found(dispatch.intensities(actors, v, Q[0], Q[1], rules))
    assert by_actor == {(1, 0): (0.5, "first"), (2, 0): (1.0, "first"), (3, 1): (1.0, "second")}
    assert found(dispatch.intensities(actors.limit(0), v, Q[0], Q[1], rules)) == {} == found(dispatch.intensities(actors, v.limit(0), Q[0], Q[1], rules))


def test_rules_are_checked(spark):
    actors = registry(spark, ACTORS)
    with pytest.raises(ValueError, match="same method"):
        dispatch.eligible(actors, [Rule("m", "x", 1), Rule("m", "y", 2)])
    with pytest.raises(ValueError, match="measure or scale"):
        dispatch.eligible(actors, [Rule("m", "x", 1, scale="odd")])
    with pytest.raises(ValueError, match="actor or quarter"):
        dispatch.intensities(actors, values(spark, []), Q[0], Q[1], wins="never")


def made_panel(spark):
    rng = random.Random(4)
    rows = [(a, dt.date(y, q, 1), rng.random()) for a in range(12) for y in range(2000, 2005) for q in (1, 4, 7, 10) if rng.random() > 0.1]
    return spark.createDataFrame(rows, "actor long, period date, value double")


def test_sums_give_what_the_rows_give(spark):
    rows = windows.windows(made_panel(spark), [2003, 2004], 3)
    blocks = spark.createDataFrame([(a, "even" if a % 2 == 0 else "odd") for a in range(12)], "actor long, block string")
    preds = ar.forecasts(windows.with_blocks(rows, blocks), {"base": [], "own": ["block"]})
    want = {(r["test_year"], p): r["r2"] for p in ("base", "own") for r in scoring.r_squared(preds, ["test_year"], pred=p, actual="value").collect()}
    both = {"both": (F.when(F.col("actor") % 2 == 0, "even").otherwise("odd"), None), "none": (F.lit(None), F.col("actor") < 100), "gone": (F.lit("x"), F.col("actor") < 0)}
    got = sufficient.scores(sufficient.statistics(rows), sufficient.membership(blocks, both)).collect()
    assert {r["variant"] for r in got} == {"both", "none"} and all(r["n_actors"] == 12 for r in got)
    for r in got:
        assert r["base_r2"] == pytest.approx(want[r["test_year"], "base"], abs=1e-12)
        assert r["mixed_r2"] == pytest.approx(want[r["test_year"], "own" if r["variant"] == "both" else "base"], abs=1e-12)


def test_versions_of_a_panel_do_not_meet(spark):
    p = made_panel(spark)
    versions = p.select(F.lit("a").alias("panel"), "*").unionByName(p.select(F.lit("b").alias("panel"), "actor", "period", (F.col("value") * 2).alias("value")))
    one = {(r["test_year"], r["actor"]): r for r in sufficient.statistics(windows.windows(p, [2003, 2004], 3)).collect()}
    many = sufficient.statistics_of_panels(versions, [2003, 2004], 3).collect()
    assert len(many) == 2 * len(one)
    for r in many:
        f = 1 if r["panel"] == "a" else 4
        assert r["xy"] == pytest.approx(f * one[r["test_year"], r["actor"]]["xy"]) and r["m"] == one[r["test_year"], r["actor"]]["m"]
