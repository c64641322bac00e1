"""Small dense numerics for one estimation window: they run inside grouped tasks and know nothing of Spark.

Matrices are periods x actors (rows in order of time) unless said otherwise.
"""

from __future__ import annotations

import numpy as np


def ewm_mean(x: np.ndarray, half_life: float = 12.0) -> np.ndarray:
    """Column means with weights halving every ``half_life`` rows back."""
    w = 0.5 ** (np.arange(len(x) - 1, -1, -1) / half_life)
    return w @ x / w.sum()


def ar_fit(y: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slope per column, mean per column): AR(1) about column means, its slope pooled over all columns or each group's."""
    mean = np.nan_to_num(y.mean(axis=0), nan=0.5)
    dev = y - mean
    num, den = (dev[1:] * dev[:-1]).sum(axis=0), (dev[:-1] ** 2).sum(axis=0)
    ids = np.zeros(y.shape[1], dtype=int) if groups is None else np.unique(groups, return_inverse=True)[1]
    top, bottom = np.bincount(ids, num), np.bincount(ids, den)
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 1e-12)[ids], mean


def one_step(y: np.ndarray, slope: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return mean + slope * (y - mean)


# --- dynamic modes --------------------------------------------------------------------------------------------


def dmd(snapshots: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Exact dynamic mode decomposition of actors x periods snapshots, at rank ``k`` at most.

    ``u`` left singular vectors, ``operator`` the reduced operator in them, ``eigenvalues`` and ``modes`` sorted by modulus, ``basis`` the
    modes as real columns: of a conjugate pair its real and imaginary part.
    """
    if snapshots.shape[1] < 2:
        raise ValueError(f"two snapshots are needed, there are {snapshots.shape[1]}")
    x, y = snapshots[:, :-1], snapshots[:, 1:]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    r = min(k, int((s > s[0] * 1e-12).sum()) or 1)
    u, s, vt = u[:, :r], s[:r], vt[:r]
    forward = y @ vt.T / np.where(s > 0, s, 1.0)
    operator = u.T @ forward
    values, vectors = np.linalg.eig(operator)
    modes = forward @ vectors / np.where(np.abs(values) > 1e-12, values, 1.0)
    order = np.argsort(-np.abs(values), kind="stable")
    values, modes = values[order], modes[:, order]
    columns = []
    for i, v in enumerate(values):
        if abs(v.imag) < 1e-12:
            columns.append(modes[:, i].real)
        elif v.imag > 0:
            columns += [modes[:, i].real, modes[:, i].imag]
    return {"u": u, "s": s, "operator": operator, "eigenvalues": values, "modes": modes, "basis": np.column_stack(columns) if columns else modes.real}


def within_radius(operator: np.ndarray, most: float = 0.99) -> np.ndarray:
    top = np.abs(np.linalg.eigvals(operator)).max(initial=0.0)
    return operator * (most / top) if top > most else operator


class Kalman:
    """Filter of K factors seen through an orthonormal basis with one noise level: y = U a + e, a' = F a + q.

    With U'U = I the gain is P (P + r I)^-1 U', so a step costs K^3 however many actors there are. Covariances are updated in
    Joseph's form; the state noise follows the innovations with weight ``adapt``.
    """

    def __init__(self, f: np.ndarray, u: np.ndarray, r: float, q: float = 0.5, adapt: float = 0.3):
        k = len(f)
        self.f, self.u, self.r, self.adapt, self.q0 = f, u, r, adapt, q
        self.reset(k)

    def reset(self, k: int) -> None:
        self.a, self.p, self.q = np.zeros(k), np.eye(k), np.eye(k) * self.q0

    def predict(self) -> np.ndarray:
        """The observation expected next."""
        self.a = self.f @ self.a
        self.p = self.f @ self.p @ self.f.T + self.q
        return self.u @ self.a

    def update(self, y: np.ndarray) -> None:
        k = len(self.a)
        gain = self.p @ np.linalg.inv(self.p + self.r * np.eye(k))
        step = gain @ (self.u.T @ y - self.a)
        keep = np.eye(k) - gain
        self.a = self.a + step
        self.p = keep @ self.p @ keep.T + self.r * gain @ gain.T
        q = (1 - self.adapt) * self.q + self.adapt * np.outer(step, step)
        self.q = (q + q.T) / 2 + 1e-6 * np.eye(k)

    def run(self, ys: np.ndarray) -> np.ndarray:
        """One-step predictions of all rows, from a fresh state."""
        self.reset(len(self.f))
        out = []
        for y in ys:
            out.append(self.predict())
            self.update(y)
        return np.array(out)


class ScalarFilters:
    """Kalman's one-factor form (U = 1) for many series side by side, each with a state of its own."""

    def __init__(self, n: int, f: float, r: float, q: float = 0.5, adapt: float = 0.3):
        self.f, self.r, self.adapt = f, r, adapt
        self.a, self.p, self.q = np.zeros(n), np.ones(n), np.full(n, q)

    def step(self, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What the series ``at`` (each once) were expected to show before ``y`` is taken in."""
        a, p = self.f * self.a[at], self.f * self.f * self.p[at] + self.q[at]
        gain = p / (p + self.r)
        step = gain * (y - a)
        self.a[at] = a + step
        self.p[at] = (1 - gain) ** 2 * p + self.r * gain**2
        self.q[at] = (1 - self.adapt) * self.q[at] + self.adapt * step**2 + 1e-6
        return a


def noise_level(x: np.ndarray, u: np.ndarray) -> float:
    """Mean square of what the basis leaves of the rows."""
    return max(float(((x - x @ u @ u.T) ** 2).mean()), 1e-8)


# --- ridge and factor regressions -----------------------------------------------------------------------------


def ridge_factors(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(P, Q) with next = P (Q now), by ridge regression over successive rows.

    Solved among the rows, of which a window has a few dozen: nothing of the columns' number squared is ever held.
    """
    a, b = x[:-1], x[1:]
    return np.linalg.solve(a @ a.T + alpha * np.eye(len(a)), b).T, a


def ridge(x: np.ndarray, alpha: float) -> np.ndarray:
    """C of next = C now: for few columns, such as factors."""
    p, q = ridge_factors(x, alpha)
    return p @ q


def singular(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular value decomposition of the product P Q, from the factors."""
    (left, r), (right, s) = np.linalg.qr(p), np.linalg.qr(q.T)
    u, values, vt = np.linalg.svd(r @ s.T)
    return left @ u[:, : len(values)], values, vt[: len(values)] @ right.T


def ridge_alpha(x: np.ndarray, n: int | None = None) -> float:
    """Of 0.1, 1 and 10 times the width ``n``, the penalty that best predicts the last two rows; the middle one if rows are few."""
    n = n or x.shape[1]
    grid = [0.1 * n, 1.0 * n, 10.0 * n]
    if len(x) - 1 < 4:
        return grid[1]
    fits = [ridge_factors(x[:-2], a) for a in grid]
    errors = [float(((x[-2:] - (x[-3:-1] @ q.T) @ p.T) ** 2).mean()) for p, q in fits]
    return grid[int(np.argmin(errors))]


def factor_var(x: np.ndarray, k: int, alpha: float = 1.0, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(basis, operator): leading principal directions and a ridge VAR of the factors in them."""
    k = max(1, min(k, (n or x.shape[1]) - 2))
    u = np.linalg.svd(x, full_matrices=False)[2][:k].T
    return u, ridge(x @ u, alpha)


def factors_for(n: int) -> int:
    return min(4, max(2, n // 5))


# --- the eight forecasts of one window ---------------------------------------------------------------------------

ARCHITECTURES = ("G0", "BA", "G1", "S1", "M1", "M2", "BA_M2", "ENS")


class _Local:
    """A block's models of demeaned residuals."""

    def __init__(self, resid: np.ndarray, k: int, with_ridge: bool, n: int):
        self.centre = ewm_mean(resid)
        d = resid - self.centre
        self.c = ridge_factors(d, ridge_alpha(d, n)) if with_ridge else None
        self.u, self.a = factor_var(d, k, n=n)

    def by_ridge(self, last: np.ndarray) -> np.ndarray:
        p, q = self.c
        return p @ (q @ (last - self.centre)) + self.centre

    def by_factors(self, last: np.ndarray) -> np.ndarray:
        return self.u @ (self.a @ (self.u.T @ (last - self.centre))) + self.centre


def forecast_window(train: np.ndarray, test: np.ndarray, block: np.ndarray, k_block: int | None = None, k_global: int = 8, k_svd: int = 15, least: int = 5, remainder: str = "REMAINDER", wanted: tuple[str, ...] = ARCHITECTURES, sizes: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """Forecasts of each test row from all rows before it, re-estimated after every row.

    Stage one is AR(1) about means, pooled (G0) or by block (BA). Stage two forecasts its residuals: in the span of all actors' leading
    dynamic modes (G1), or in named blocks of ``least`` actors or more by ridge (M1) or factors (M2, BA_M2), the remainder as in
    G1 (BA_M2: as in BA). S1 leaves named blocks at stage one; ENS averages G1 and BA. A named block that is too small
    stays at stage one in M1 and at the global forecast in M2. The first test row has no residual forecast from modes: its state is at rest.
    Only ``wanted`` ones are computed. ``sizes``: numbers of actors by block, where columns stand for more (``operators.spans``).
    """
    sizes = sizes or dict(zip(*np.unique(block, return_counts=True), strict=True))
    width = sum(sizes.values())
    local = [(np.flatnonzero(block == b), int(sizes[b])) for b in sorted(set(block.tolist()) - {remainder})]
    out: dict[str, list[np.ndarray]] = {a: [] for a in ARCHITECTURES}
    y = train
    for t, actual in enumerate(test):
        slope, mean = ar_fit(y)
        slope_b, mean_b = ar_fit(y, block)
        resid, resid_b = y[1:] - one_step(y[:-1], slope, mean), y[1:] - one_step(y[:-1], slope_b, mean_b)
        pool, pool_b = one_step(y[-1], slope, mean), one_step(y[-1], slope_b, mean_b)
        centre = ewm_mean(resid)
        d = resid - centre
        modes = dmd(d.T, k_svd)
        k = max(1, min(k_global, width - 2, len(modes["operator"])))
        u, f = modes["u"][:, :k], within_radius(modes["operator"][:k, :k].real)
        # At the year's start the factors are at rest; later they are the last residual's projection.
        factors = f @ (u.T @ (last_resid - centre)) if t else np.zeros(k)
        aug = pool + u @ factors + centre
        s1, m1, m2, bm2 = aug.copy(), aug.copy(), aug.copy(), pool_b.copy()
        for at, n in local:
            s1[at] = pool[at]
            if n < least:
                m1[at] = pool[at]
                continue
            k_b = k_block or factors_for(n)
            if "M1" in wanted or "M2" in wanted:
                a = _Local(resid[:, at], k_b, "M1" in wanted, n)
                m1[at] = pool[at] + a.by_ridge(resid[-1, at]) if "M1" in wanted else pool[at]
                m2[at] = pool[at] + a.by_factors(resid[-1, at])
            if "BA_M2" in wanted:
                b = _Local(resid_b[:, at], k_b, False, n)
                bm2[at] = pool_b[at] + b.by_factors(resid_b[-1, at])
        for name, p in zip(ARCHITECTURES, (pool, pool_b, aug, s1, m1, m2, bm2, (aug + pool_b) / 2), strict=True):
            out[name].append(p)
        last_resid = actual - pool
        y = np.vstack([y, actual])
    return {a: np.array(out[a]) for a in wanted}


def lag_correlation(x: np.ndarray) -> np.ndarray:
    """Correlation of each column with itself a row later; 0 for fewer than three rows or a column that doesn't move."""
    if len(x) < 3:
        return np.zeros(x.shape[1])
    a, b = x[:-1] - x[:-1].mean(axis=0), x[1:] - x[1:].mean(axis=0)
    scale = np.sqrt((a**2).sum(axis=0) * (b**2).sum(axis=0))
    moves = (x[:-1].std(axis=0) > 1e-10) & (scale > 0)
    return np.divide((a * b).sum(axis=0), scale, out=np.zeros(x.shape[1]), where=moves)


def transition(z: np.ndarray, alpha: float) -> np.ndarray:
    """C of next = C now by ridge regression, solved among the columns: for factors, and penalties near 0."""
    a, b = z[:-1], z[1:]
    return np.linalg.solve(a.T @ a + alpha * np.eye(z.shape[1]), a.T @ b).T


def own_methods(y: np.ndarray, first: int, slopes: np.ndarray) -> dict[str, np.ndarray]:
    """The two references of ``method_window`` that know only a column's own past: AR(1) of it, and of what the pooled AR(1) leaves (``slopes``: by test row)."""
    out: dict[str, list[np.ndarray]] = {"ar1": [], "residual_ar1": []}
    before = None
    for t, slope in zip(range(first, len(y)), slopes, strict=True):
        past = y[:t]
        mean = past.mean(axis=0)
        resid, pool = past[1:] - one_step(past[:-1], slope, mean), one_step(past[-1], slope, mean)
        level = resid.mean(axis=0)
        out["ar1"].append(one_step(past[-1], lag_correlation(past), mean))
        out["residual_ar1"].append(pool + level + lag_correlation(resid) * ((np.zeros(y.shape[1]) if before is None else before) - level))
        before = y[t] - pool
    return {a: np.array(p) for a, p in out.items()}


def pooled_slopes(train: np.ndarray, test: np.ndarray) -> np.ndarray:
    """The pooled AR(1)'s slope before each test row."""
    y = np.vstack([train, test])
    return np.array([ar_fit(y[:t])[0][0] for t in range(len(train), len(y))])


def method_window(train: np.ndarray, test: np.ndarray, k: int = 8, width: int | None = None) -> dict[str, np.ndarray]:
    """Thirteen forecasts side by side: PCA or DMD bases with diagonal, full or ridge dynamics, raw and reduced-rank ridge, and three references.

    All but two references add to the pooled first stage what they expect of its residual; everything is re-estimated after each test row. They start
    from the last forecast's residual, which is 0 at the year's start. ``_filtered`` ones start there from factors at rest instead; their filter starts
    anew with each re-estimation, so that it comes to the projection of that residual. With ``width``, the number of actors that fewer columns
    stand for, the references of a column's own past (``own_methods``) are left out.
    """
    out: dict[str, list[np.ndarray]] = {}
    y, before = train, None
    for actual in test:
        slope, mean = ar_fit(y)
        resid, pool = y[1:] - one_step(y[:-1], slope, mean), one_step(y[-1], slope, mean)
        centre = ewm_mean(resid)
        d = resid - centre
        columns, n = d.shape[1], width or d.shape[1]
        kk = max(1, min(k, n - 2))
        modes = dmd(d.T, 15)
        u_dmd, a_dmd = modes["u"][:, :kk], modes["operator"][:kk, :kk].real
        u_pca = np.linalg.svd(d, full_matrices=False)[2][:kk].T
        z = d @ u_pca
        phi = np.diag(np.clip(lag_correlation(z), -0.99, 0.99))
        diagonal = within_radius(np.diag(np.diag(a_dmd)))
        p, q = ridge_factors(d, max(1.0, 0.1 * n))
        left, s, right = singular(*ridge_factors(d, max(1.0, 0.01 * n)))
        last = (np.zeros(columns) if before is None else before) - centre
        rest = np.zeros(columns) if before is None else last
        near = lambda u, a, x: pool + centre + u @ (a @ (u.T @ x))  # noqa: B023, E731
        forecasts = {
            "pooled": pool,
            "pca_diag": near(u_pca, phi, last), "pca_diag_filtered": near(u_pca, phi, rest), "pca_var": near(u_pca, transition(z, 1e-8), last), "pca_ridge": near(u_pca, transition(z, 1.0), last),
            "dmd_diag": near(u_dmd, diagonal, last), "dmd_diag_filtered": near(u_dmd, diagonal, rest), "dmd_full_filtered": near(u_dmd, within_radius(a_dmd), rest),
            "dmd_ridge": near(u_dmd, transition(d @ u_dmd, 1.0), last),
            "ridge": pool + centre + p @ (q @ last), "reduced_rank": pool + centre + (left[:, :k] * s[:k]) @ (right[:k] @ last),
        }
        for name, pred in forecasts.items():
            out.setdefault(name, []).append(pred)
        before = actual - pool
        y = np.vstack([y, actual])
    return {a: np.array(p) for a, p in out.items()} | ({} if width else own_methods(y, len(train), pooled_slopes(train, test)))


def diagnostics(resid: np.ndarray, ones: np.ndarray | None = None, n: int | None = None) -> dict[str, float]:
    """What a gate may look at: effective rank and persistence of residuals, and the share that the leading modes explain.

    Where columns stand for ``n`` actors, ``ones`` are the coordinates of the vector of ones: a row's product with it is the sum over actors.
    """
    ones, n = np.ones(resid.shape[1]) if ones is None else ones, n or resid.shape[1]
    s = np.linalg.svd(resid - resid.mean(axis=0), compute_uv=False)[: min(n, len(resid))] ** 2
    s = np.concatenate([s, np.zeros(min(n, len(resid)) - len(s))])
    p = s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s))
    entropy = -float((p[p > 0] * np.log(p[p > 0])).sum())
    a, b = resid[1:], resid[:-1]
    count = n * len(a)
    mean_a, mean_b = (a @ ones).sum() / count, (b @ ones).sum() / count
    var_a, var_b = (a**2).sum() / count - mean_a**2, (b**2).sum() / count - mean_b**2
    rho = float(((a * b).sum() / count - mean_a * mean_b) / np.sqrt(var_a * var_b)) if min(var_a, var_b) > 1e-24 else 0.0
    return {"eff_rank": float(np.exp(entropy)), "persistence": rho, "expl_var": float(p[: min(8, len(p))].sum())}


#: A tree of depth 2 is 3 cuts of (column, at most, whether there is a cut) and 4 values.
_TREE = 13


def boosted_trees(x: np.ndarray, y: np.ndarray, trees: int = 50, rate: float = 0.1, share: float = 0.8, seed: int = 42) -> np.ndarray:
    """Gradient boosting on squared error with depth-2 trees on random row shares, as numbers for ``grown_values``: start, rate, trees.

    Columns are sorted once; a node takes its rows from that order.
    """
    rng = np.random.default_rng(seed)
    start = float(y.mean())
    fitted = np.full(len(y), start)
    orders = [np.argsort(x[:, c], kind="stable") for c in range(x.shape[1])]
    out = [np.array([start, rate])]

    def cut(inside: np.ndarray, r: np.ndarray):
        best = None
        for c, order in enumerate(orders):
            at = order[inside[order]]
            if len(at) < 2:
                return None
            v, sums, n = x[at, c], np.cumsum(r[at]), np.arange(1, len(at))
            gain = sums[:-1] ** 2 / n + (sums[-1] - sums[:-1]) ** 2 / (len(at) - n) - sums[-1] ** 2 / len(at)
            gain[v[1:] <= v[:-1]] = -1
            i = int(np.argmax(gain))
            if gain[i] > 1e-15 and (best is None or gain[i] > best[0]):
                best = (float(gain[i]), c, float((v[i] + v[i + 1]) / 2))
        return best

    for _ in range(trees):
        r = y - fitted
        inside = np.zeros(len(y), dtype=bool)
        inside[rng.choice(len(y), max(1, int(share * len(y))), replace=False)] = True
        tree = np.zeros(_TREE)
        top = cut(inside, r)
        if top:
            tree[:3] = top[1], top[2], 1
            low = x[:, top[1]] <= top[2]
            for side, part in enumerate((inside & low, inside & ~low)):
                down = cut(part, r)
                if down:
                    lower = x[:, down[1]] <= down[2]
                    tree[3 + 3 * side : 6 + 3 * side] = down[1], down[2], 1
                    tree[9 + 2 * side : 11 + 2 * side] = r[part & lower].mean(), r[part & ~lower].mean()
                else:
                    tree[9 + 2 * side : 11 + 2 * side] = r[part].mean()
        else:
            tree[9:] = r[inside].mean()
        out.append(tree)
        fitted = fitted + rate * _tree_values(tree, x)
    return np.concatenate(out)


def _tree_values(tree: np.ndarray, rows: np.ndarray) -> np.ndarray:
    def below(at: int) -> np.ndarray:
        c, v, there = tree[at : at + 3]
        return rows[:, int(c)] <= v if there else np.ones(len(rows), dtype=bool)

    top = below(0)
    return np.where(top, np.where(below(3), tree[9], tree[10]), np.where(below(6), tree[11], tree[12]))


def grown_values(grown: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return grown[0] + grown[1] * sum(_tree_values(t, rows) for t in grown[2:].reshape(-1, _TREE))


def boosted_stumps(x: np.ndarray, y: np.ndarray, trees: int = 50, rate: float = 0.1, share: float = 0.8, seed: int = 42):
    """``boosted_trees`` as a function of new rows."""
    grown = boosted_trees(x, y, trees, rate, share, seed)
    return lambda rows: grown_values(grown, rows)


def boosted_side_by_side(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, trees: int = 50, rate: float = 0.1, share: float = 0.8, seed: int = 42) -> np.ndarray:
    """Values at ``ahead`` (models x new rows x columns) of as many ``boosted_trees`` as ``y`` has rows, each on its own x (models x rows x columns).

    Models have the same number of rows, so a tree's random rows are the same in all and all grow at once; rows outside a node sort behind its own.
    """
    rng = np.random.default_rng(seed)
    models, m = y.shape
    who = np.arange(models)
    start = y.mean(axis=1, keepdims=True)
    fitted, out = np.repeat(start, m, axis=1), np.repeat(start, ahead.shape[1], axis=1)
    orders = [np.argsort(x[:, :, c], axis=1, kind="stable") for c in range(x.shape[2])]

    def mean(inside: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (r * inside).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)

    def cut(inside: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column, at most, whether there is a cut) of each model's node."""
        size = inside.sum(axis=1)
        best, column, most = np.full(models, 1e-15), np.zeros(models, dtype=int), np.zeros(models)
        n = np.arange(1, m)
        for c, order in enumerate(orders):
            held = np.take_along_axis(inside, order, axis=1)
            at = np.take_along_axis(order, np.argsort(~held, axis=1, kind="stable"), axis=1)
            v = np.take_along_axis(x[:, :, c], at, axis=1)
            sums = np.cumsum(np.take_along_axis(r * inside, at, axis=1), axis=1)
            all_ = sums[:, -1:]
            rest = size[:, None] - n
            gain = sums[:, :-1] ** 2 / n + (all_ - sums[:, :-1]) ** 2 / np.maximum(rest, 1) - all_**2 / np.maximum(size, 1)[:, None]
            gain[(v[:, 1:] <= v[:, :-1]) | (rest < 1)] = -1
            i = np.argmax(gain, axis=1)
            better = gain[who, i] > best
            best = np.where(better, gain[who, i], best)
            column = np.where(better, c, column)
            most = np.where(better, (v[who, i] + v[who, i + 1]) / 2, most)
        return column, most, best > 1e-15

    def below(node: tuple, rows: np.ndarray) -> np.ndarray:
        column, most, there = node
        return (np.take_along_axis(rows, np.broadcast_to(column[:, None, None], (*rows.shape[:2], 1)), axis=2)[:, :, 0] <= most[:, None]) | ~there[:, None]

    for _ in range(trees):
        r = y - fitted
        inside = np.zeros((models, m), dtype=bool)
        inside[:, rng.choice(m, max(1, int(share * m)), replace=False)] = True
        top = cut(inside, r)
        low, ahead_low = below(top, x), below(top, ahead)
        step, far = np.zeros_like(y), np.zeros_like(out)
        for side, ahead_side in ((low, ahead_low), (~low, ~ahead_low)):
            part = inside & side
            # Where there is no cut at the top, all rows are on the low side and stay together.
            column, most, there = cut(part, r)
            down = (column, most, there & top[2])
            lower, ahead_lower = below(down, x), below(down, ahead)
            values = mean(part & lower, r)[:, None], mean(part & ~lower, r)[:, None]
            step = np.where(side, np.where(lower, *values), step)
            far = np.where(ahead_side, np.where(ahead_lower, *values), far)
        fitted, out = fitted + rate * step, out + rate * far
    return out


# --- subspaces ------------------------------------------------------------------------------------------------------


def orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x)[0]


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between two column spans, largest first."""
    s = np.linalg.svd(orthonormal(a).T @ orthonormal(b), compute_uv=False)
    return np.sort(np.arccos(np.clip(s, -1, 1)))[::-1]


def subspace_distances(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Chordal and projector distance and the correlation 1 - chordal^2 / K."""
    s2 = float((np.sin(principal_angles(a, b)) ** 2).sum())
    return {"chordal": s2**0.5, "frobenius": (2 * s2) ** 0.5, "correlation": 1 - s2 / a.shape[1]}


def tangent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The direction from span a to span b on the Grassmann manifold, as long as the way."""
    inner = a.T @ b
    u, s, vt = np.linalg.svd((b - a @ inner) @ np.linalg.pinv(inner), full_matrices=False)
    return u * np.arctan(s) @ vt


def along(a: np.ndarray, direction: np.ndarray, step: float = 1.0) -> np.ndarray:
    """Where a geodesic from span a ends."""
    u, s, vt = np.linalg.svd(direction, full_matrices=False)
    return orthonormal(a @ vt.T * np.cos(step * s) @ vt + u * np.sin(step * s) @ vt)


def mean_subspace(parts: list[np.ndarray], rounds: int = 30, tolerance: float = 1e-8) -> np.ndarray:
    """Karcher mean."""
    m = orthonormal(parts[0])
    for _ in range(rounds):
        g = sum(tangent(m, orthonormal(p)) for p in parts) / len(parts)
        m = along(m, g)
        if np.linalg.norm(g) < tolerance:
            break
    return m


def leading(projector: np.ndarray, k: int) -> np.ndarray:
    return np.linalg.eigh((projector + projector.T) / 2)[1][:, ::-1][:, :k]


def rotation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Orthogonal Procrustes rotation that takes basis a closest to basis b."""
    u, _, vt = np.linalg.svd(orthonormal(a).T @ orthonormal(b))
    return u @ vt


def subspace_forecasts(past: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Next subspace from those so far (two at least): persistence, projector extrapolations, geodesic steps and means of the last four."""
    now, k = past[-1], past[-1].shape[1]
    proj = [p @ p.T for p in past]
    steps = np.diff(np.array(proj), axis=0)
    w = 0.5 ** (np.arange(len(steps) - 1, -1, -1) / 4)
    ways = [tangent(orthonormal(a), orthonormal(b)) for a, b in zip(past[:-1], past[1:], strict=True)]
    speed = float(np.mean([np.linalg.norm(x) for x in ways]))
    last = ways[-1]
    turn = np.linalg.norm(last)
    return {
        "persistence": now, "linear": leading(2 * proj[-1] - proj[-2], k), "mean_step": leading(proj[-1] + steps.mean(axis=0), k),
        "ewm_step": leading(proj[-1] + np.tensordot(w / w.sum(), steps, axes=1), k),
        "mean_speed": along(orthonormal(past[-2]), last, 1 + speed / turn) if turn > 1e-12 else now,
        "projector_mean": leading(sum(proj[-4:]) / len(proj[-4:]), k), "karcher_mean": mean_subspace(past[-4:]),
    }


def turning(bases: list[np.ndarray]) -> list[dict[str, float]]:
    """Of each basis against the one before: rotation angle, geodesic length, largest principal angle, and the cosine with the last turn.

    The turn is the skew part of the Procrustes rotation's logarithm, taken from its eigenvalues.
    """
    out, last = [], None
    for a, b in zip(bases[:-1], bases[1:], strict=True):
        q = rotation(a, b)
        k = len(q)
        values, vectors = np.linalg.eig(q)
        log = (vectors * (1j * np.angle(values))) @ np.linalg.pinv(vectors)
        skew = (log.real - log.real.T) / 2
        turn = skew[np.triu_indices(k, 1)]
        norms = np.linalg.norm(turn) * (np.linalg.norm(last) if last is not None else 0.0)
        out.append(
            {
                "angle": float(np.arccos(np.clip((np.trace(q) - 1) / max(k - 1, 1), -1, 1))), "geodesic": float(np.linalg.norm(tangent(orthonormal(a), orthonormal(b)))),
                "largest": float(principal_angles(a, b)[0]), "stability": float(turn @ last / norms) if norms > 1e-15 else 0.0,
            }
        )
        last = turn
    return out


def autoregressive_subspaces(past: list[np.ndarray], penalty: float = 0.1) -> dict[str, np.ndarray]:
    """Next subspace by regressions on the past (three at least): tangent AR, AR(1) of each angle, and two lags of the projectors."""
    now, k = orthonormal(past[-1]), past[-1].shape[1]
    ways = [tangent(orthonormal(a), orthonormal(b)) for a, b in zip(past[:-1], past[1:], strict=True)]
    angles = np.array([np.linalg.svd(w, compute_uv=False)[:k] for w in ways])
    u, s, vt = np.linalg.svd(-tangent(now, orthonormal(past[-2])), full_matrices=False)  # the last step's direction, seen from now
    a, b = angles[:-1], angles[1:]
    common = float((a * b).sum() / ((a**2).sum() + penalty))
    mean = angles.mean(axis=0)
    da, db = a - mean, b - mean
    den = (da**2).sum(axis=0)
    each = np.clip(np.divide((da * db).sum(axis=0), den, out=np.zeros_like(den), where=den > 1e-12), -0.99, 0.99)
    step = lambda size: along(now, u * np.maximum(size, 0.0) @ vt)
    proj = [p @ p.T for p in past]
    gram = np.array([[sum(float((proj[t - i] * proj[t - j]).sum()) for t in range(2, len(proj))) for j in (1, 2)] for i in (1, 2)])
    right = np.array([sum(float((proj[t - i] * proj[t]).sum()) for t in range(2, len(proj))) for i in (1, 2)])
    w = np.linalg.solve(gram + 1e-6 * np.eye(2), right)
    return {"tangent_ar": step(common * s), "angle_ar": step(mean + each * (angles[-1] - mean)), "projector_ar2": leading(w[0] * proj[-1] + w[1] * proj[-2], k)}
