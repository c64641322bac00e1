from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from panelloom.functions import kernels as K
from panelloom.operators import forecast as fc
from panelloom.operators import spans


def made(n: int, quarters: int = 16, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    y = np.random.default_rng(seed).random((quarters, n))
    return y, np.array([("A", "B", "REMAINDER")[i % 3] for i in range(n)])


def rows_of(spark, y, block, train=12):
    day = [dt.date(2000 + q // 4, 3 * (q % 4) + 1, 1) for q in range(len(y))]
    return spark.createDataFrame([(2003, i, day[q], float(y[q, i]), q < train, str(block[i])) for q in range(len(y)) for i in range(y.shape[1])], "test_year int, actor long, period date, value double, train boolean, block string").repartition(3)


@pytest.mark.parametrize("n", [7, 17, 90])
def test_forecasts_from_sums_are_those_from_actors(spark, n):
    y, block = made(n)
    want = K.forecast_window(y[:12], y[12:], block)
    for r in fc.eight_architectures(rows_of(spark, y, block)).collect():
        q = (r["period"].month - 1) // 3
        assert r["pred"] == pytest.approx(want[r["arch"]][q, r["actor"]], abs=1e-7) and r["actual"] == y[12 + q, r["actor"]]
    methods = K.method_window(y[:12], y[12:])
    for r in fc.method_scores(rows_of(spark, y, block), ["test_year", "arch"]).collect():
        e = y[12:] - methods[r["arch"]]
        assert r["r2"] == pytest.approx(1 - (e**2).sum() / ((y[12:] - y[12:].mean()) ** 2).sum(), abs=1e-7) and r["mae"] == pytest.approx(np.abs(e).mean(), abs=1e-8)


@pytest.mark.parametrize("fixed", [(), ("REMAINDER",)])
def test_placebos_from_sums_are_those_from_actors(spark, fixed):
    y, block = made(31)
    free = ~np.isin(block, fixed)
    got = {(r["variant"], r["arch"]): r["r2"] for r in fc.placebo(rows_of(spark, y, block), 9, fixed=fixed, a_task=4, chunk=8).collect()}
    assert len(got) == 11
    for (variant, arch), r2 in got.items():
        dealt = block.copy()
        if variant != "real":
            dealt[free] = np.random.default_rng([42, int(variant)]).permutation(block[free])
        e = y[12:] - K.forecast_window(y[:12], y[12:], dealt, wanted=(arch,))[arch]
        assert r2 == pytest.approx(1 - (e**2).sum() / ((y[12:] - y[12:].mean()) ** 2).sum(), abs=1e-7)


def test_solved_windows_hold_nothing_of_the_actors(spark):
    sizes = []
    for n in (40, 400):
        y, block = made(n)
        part = spans.moments(spans.packed(rows_of(spark, y, block)).coalesce(1)).collect()
        sizes.append(sorted((r["block"], len(r["products"])) for r in part))
    assert sizes[0] == sizes[1] == [("A", 256), ("B", 256), ("REMAINDER", 256)]


def test_trees_side_by_side_are_those_of_one_model_each():
    rng = np.random.default_rng(8)
    x, y, ahead = rng.random((20, 10, 2)).round(1), rng.random((20, 10)), rng.random((20, 4, 2))
    y[0] = 0.5
    got = K.boosted_side_by_side(x, y, ahead)
    for i in range(20):
        assert got[i] == pytest.approx(K.boosted_stumps(x[i], y[i])(ahead[i]), abs=1e-9)


def test_diagnostics_of_columns_that_stand_for_actors():
    y, _ = made(50)
    c = spans.centred(y.T)
    short, back = spans.basis(c.T @ c, 50)
    got, want = K.diagnostics(short, c.sum(axis=0) @ back, 50), K.diagnostics(y - y.mean(axis=0))
    assert got == pytest.approx(want)
    assert want["persistence"] == pytest.approx(np.corrcoef((y - y.mean(axis=0))[1:].ravel(), (y - y.mean(axis=0))[:-1].ravel())[0, 1])


def test_subspaces_of_many_actors_need_no_square_of_them(spark):
    y, _ = made(3000, 18)
    got = fc.subspace_accuracy(rows_of(spark, y, np.full(3000, "")), years=3, k=3).collect()
    bases = []
    for t in range(12, 19):
        part = y[t - 12 : t]
        bases.append(K.orthonormal(K.dmd((part - K.ewm_mean(part)).T, 3)["u"]))
    told = {(r["model"], r["period"]): r["chordal"] for r in got}
    last = max(p for _, p in told)
    assert len(got) == 3 * 10 and told["persistence", last] == pytest.approx(K.subspace_distances(bases[-2], bases[-1])["chordal"], abs=1e-7)
