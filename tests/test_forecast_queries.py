from __future__ import annotations

import numpy as np

from panelloom.functions import kernels
from panelloom.plans import registry


def test_wanted_forecasts_equal_all():
    rng = np.random.default_rng(1)
    train, test = rng.random((12, 14)), rng.random((4, 14))
    block = np.array(["A"] * 6 + ["REMAINDER"] * 8)
    every = kernels.forecast_window(train, test, block)
    for wanted in (("G1", "M2"), ("G1",), ("M1",), ("BA_M2",)):
        some = kernels.forecast_window(train, test, block, wanted=wanted)
        assert tuple(some) == wanted and all(np.array_equal(some[a], every[a]) for a in wanted)


def test_placebo_draws_as_many_as_the_reference(spark, sf):
    assert registry.QUERIES["placebo_test"](spark, sf).first()["n"] == 1000


def test_grid_has_all_cells(spark, sf):
    rows = registry.QUERIES["window_factor_grid"](spark, sf).select("years", "variant", "test_year").distinct().collect()
    assert {(r["years"], r["variant"]) for r in rows} == {(t, k) for t in (2, 3, 5) for k in "2346"}
    assert {r["test_year"] for r in rows if r["years"] == 5} == {2000, 2001}


def test_split_half_uses_as_many_splits_as_the_reference(spark):
    assert registry.QUERIES["split_half_reliability"](spark, "/root/testdata/sf0.01").first()["n"] == 30
