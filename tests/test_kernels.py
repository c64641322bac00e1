from __future__ import annotations

import numpy as np
import pytest

from panelloom.functions import kernels as K


def test_dmd_recovers_a_linear_system():
    a, x = np.array([[0.9, 0.2], [-0.1, 0.8]]), [np.array([1.0, 0.5])]
    for _ in range(8):
        x.append(a @ x[-1])
    found = K.dmd(np.array(x).T, 2)
    assert sorted(found["eigenvalues"].imag) == pytest.approx([-0.13228757, 0.13228757]) and found["eigenvalues"].real == pytest.approx([0.85, 0.85])
    assert found["basis"].shape == (2, 2) and np.isrealobj(found["basis"])
    with pytest.raises(ValueError):
        K.dmd(np.ones((3, 1)), 2)


def test_kalman_equals_the_dense_form():
    rng = np.random.default_rng(1)
    u, f, r = K.orthonormal(rng.normal(size=(9, 3))), K.within_radius(rng.normal(size=(3, 3))), 0.3
    filt = K.Kalman(f, u, r)
    a, p, q = np.zeros(3), np.eye(3), np.eye(3) * 0.5
    for y in rng.normal(size=(6, 9)):
        a, p = f @ a, f @ p @ f.T + q
        assert filt.predict() == pytest.approx(u @ a, abs=1e-9)
        gain = p @ u.T @ np.linalg.inv(u @ p @ u.T + r * np.eye(9))
        step = gain @ (y - u @ a)
        a, p = a + step, (np.eye(3) - gain @ u) @ p
        q = 0.7 * q + 0.3 * np.outer(step, step)
        q = (q + q.T) / 2 + 1e-6 * np.eye(3)
        filt.update(y)
        assert filt.a == pytest.approx(a, abs=1e-9) and filt.p == pytest.approx(p, abs=1e-9)
    assert filt.run(rng.normal(size=(4, 9))).shape == (4, 9)


def test_forecasts_of_a_window():
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=(24, 16)), axis=0) / 10
    block = np.array(["a"] * 6 + ["b"] * 3 + ["REMAINDER"] * 7)
    f = K.forecast_window(y[:20], y[20:], block)
    slope, mean = K.ar_fit(y[:20])
    assert f["G0"][0] == pytest.approx(K.one_step(y[19], slope, mean))
    assert f["ENS"] == pytest.approx((f["G1"] + f["BA"]) / 2)
    assert f["S1"][:, :9] == pytest.approx(f["G0"][:, :9]) and f["S1"][:, 9:] == pytest.approx(f["G1"][:, 9:])
    assert f["M1"][:, 6:9] == pytest.approx(f["G0"][:, 6:9]) and f["M2"][:, 6:] == pytest.approx(f["G1"][:, 6:])
    one = K.forecast_window(y[:20], y[20:], np.array(["REMAINDER"] * 16))
    assert one["BA"] == pytest.approx(one["G0"]) and one["M2"] == pytest.approx(one["G1"])


def test_ridge_shrinks_and_picks_a_penalty():
    x = np.random.default_rng(3).normal(size=(12, 4))
    assert np.linalg.norm(K.ridge(x, 1e6)) < 1e-3 < np.linalg.norm(K.ridge(x, 0.1)) and K.ridge_alpha(x) in (0.4, 4.0, 40.0) and K.ridge_alpha(x[:4]) == 4.0


def test_subspaces():
    rng = np.random.default_rng(4)
    u, v = (K.orthonormal(rng.normal(size=(8, 3))) for _ in range(2))
    assert K.subspace_distances(u, u)["chordal"] == pytest.approx(0, abs=1e-7)
    assert K.subspace_distances(K.along(u, K.tangent(u, v)), v)["chordal"] == pytest.approx(0, abs=1e-6)
    assert K.subspace_distances(K.mean_subspace([u, u, u]), u)["chordal"] == pytest.approx(0, abs=1e-7)
    q = K.orthonormal(rng.normal(size=(3, 3)))
    assert K.rotation(K.orthonormal(u), K.orthonormal(u)) == pytest.approx(np.eye(3), abs=1e-9) and q.shape == (3, 3)
    plane = lambda t: np.array([[np.cos(t), 0], [np.sin(t), 0], [0, 1.0]])
    turned = K.turning([plane(0.1 * t) for t in range(4)])
    assert [round(x["geodesic"], 6) for x in turned] == [0.1] * 3 and turned[0]["largest"] == pytest.approx(0.1)
    ahead = K.autoregressive_subspaces([plane(0.1 * t) for t in range(8)], penalty=0.0)["tangent_ar"]
    assert K.subspace_distances(ahead, plane(0.8))["chordal"] == pytest.approx(0, abs=1e-6)
    for name, guess in (K.subspace_forecasts([u] * 5) | K.autoregressive_subspaces([u] * 5)).items():
        assert K.subspace_distances(guess, u)["chordal"] == pytest.approx(0, abs=1e-6), name


def test_boosting_fits_a_step():
    x = np.linspace(0, 1, 60)[:, None]
    y = (x[:, 0] > 0.5).astype(float)
    assert np.abs(K.boosted_stumps(x, y)(x) - y).mean() < 0.1


def test_ridge_among_rows_equals_the_normal_equations():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(9, 14))
    a, b = x[:-1], x[1:]
    dense = np.linalg.solve(a.T @ a + 0.7 * np.eye(14), a.T @ b).T
    assert np.allclose(K.ridge(x, 0.7), dense)
    left, s, right = K.singular(*K.ridge_factors(x, 0.7))
    assert np.allclose((left * s) @ right, dense) and np.allclose(s[:5], np.linalg.svd(dense)[1][:5])
    _, vectors = np.linalg.eigh(x.T @ x)
    u, _ = K.factor_var(x, 3)
    assert np.allclose(u @ u.T, vectors[:, -3:] @ vectors[:, -3:].T)


def test_thirteen_methods():
    rng = np.random.default_rng(5)
    train, test = rng.random((14, 9)), rng.random((3, 9))
    got = K.method_window(train, test, k=4)
    assert len(got) == 13 and all(p.shape == test.shape and np.isfinite(p).all() for p in got.values())
    # At the year's start nothing is known of the last residual: filtered factors are at rest, others see minus its centre.
    slope, mean = K.ar_fit(train)
    resid = train[1:] - K.one_step(train[:-1], slope, mean)
    start = K.one_step(train[-1], slope, mean) + K.ewm_mean(resid)
    for name in ("pca_diag_filtered", "dmd_diag_filtered", "dmd_full_filtered"):
        assert np.allclose(got[name][0], start)
    for name in ("pca_diag", "dmd_diag"):
        assert not np.allclose(got[name][0], got[name + "_filtered"][0]) and np.allclose(got[name][1:], got[name + "_filtered"][1:])
    # The references, written out plainly for the second row.
    seen = np.vstack([train, test[:1]])
    slope2, mean2 = K.ar_fit(seen)
    resid2 = seen[1:] - K.one_step(seen[:-1], slope2, mean2)
    rho = np.array([np.corrcoef(r[:-1], r[1:])[0, 1] for r in resid2.T])
    before = test[0] - K.one_step(train[-1], slope, mean)
    level = resid2.mean(axis=0)
    assert np.allclose(got["residual_ar1"][1], K.one_step(seen[-1], slope2, mean2) + level + rho * (before - level))
    own = np.array([np.corrcoef(c[:-1], c[1:])[0, 1] for c in seen.T])
    assert np.allclose(got["ar1"][1], mean2 + own * (seen[-1] - mean2))
    # Ridge against the plain normal equations.
    centre = K.ewm_mean(resid2)
    d = resid2 - centre
    c = np.linalg.solve(d[:-1].T @ d[:-1] + max(1.0, 0.9) * np.eye(9), d[:-1].T @ d[1:]).T
    assert np.allclose(got["ridge"][1], K.one_step(seen[-1], slope2, mean2) + centre + c @ (before - centre))


def test_lag_correlation_of_what_does_not_move():
    assert K.lag_correlation(np.ones((5, 2))).tolist() == [0.0, 0.0] and K.lag_correlation(np.eye(2)).tolist() == [0.0, 0.0]
