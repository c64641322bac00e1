"""Windows by inner products of their quarters, so that no task holds a window's actors.

Stages of a forecast see actors only through sums over them of products of two quarters' values: slopes, singular values, factors,
ridge solutions. So each block's sums (quarters x quarters) stand for its actors: ``panel`` makes a panel of as few columns as
quarters with the same sums, on which the kernels run. Forecasts come back as weights on an actor's own quarters, and every
row is forecast where it lies. Values are taken about the actor's mean over the window, which all models carry through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import kernels

#: (train, test, block, sizes) -> forecasts by variant and architecture, quarters x columns; sizes: block -> number of actors.
Model = Callable[[np.ndarray, np.ndarray, np.ndarray, dict[str, int]], dict[tuple[str, str], np.ndarray]]
#: (quarters x actors, number of training quarters, pooled slopes before each test quarter, test year) -> forecasts that no sum over actors gives, from actors' own values.
Own = Callable[[np.ndarray, int, np.ndarray, int], dict[tuple[str, str], np.ndarray]]
_SLOPES = ("", "slopes")


def packed(rows: DataFrame) -> DataFrame:
    """(test_year, actor, block, y, train): an actor's quarters of a window in one row, and how many of them are for training."""
    block = F.first("block") if "block" in rows.columns else F.lit("")
    g = rows.groupBy("test_year", "actor").agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("y"), block.alias("block"), F.count_if("train").cast("int").alias("train"))
    return g.select("test_year", "actor", "block", F.transform("y", lambda p: p["value"]).alias("y"), "train")


def periods(rows: DataFrame) -> dict[int, list]:
    """test_year -> its test quarters."""
    found = rows.where(~F.col("train")).groupBy("test_year").agg(F.sort_array(F.collect_set("period")).alias("p")).collect()
    return {r["test_year"]: r["p"] for r in found}


def matrix(y: pd.Series) -> np.ndarray:
    return np.stack(y.to_numpy()) if len(y) else np.empty((0, 0))


def centred(y: np.ndarray) -> np.ndarray:
    return y - y.mean(axis=1, keepdims=True)


_MOMENTS = "test_year int, block string, train int, n long, total array<double>, products array<double>"


def moments(rows: DataFrame) -> DataFrame:
    """(test_year, block, train, n, total, products) of ``packed`` rows: each task's sums over actors of centred quarters, and of their products."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for key, part in batch.groupby(["test_year", "block", "train"]):
                c = centred(matrix(part["y"]))
                had = found.setdefault(key, [0, 0.0, 0.0])
                found[key] = [had[0] + len(c), had[1] + c.sum(axis=0), had[2] + c.T @ c]
        yield pd.DataFrame([(*key, n, s, k.ravel()) for key, (n, s, k) in found.items()], columns=[c.split()[0] for c in _MOMENTS.split(", ")])

    return rows.select("test_year", "block", "train", "y").mapInPandas(sums, _MOMENTS)


def by_label(c: np.ndarray, of: np.ndarray, labels: int, piece: int = 2048) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """label -> (actors, sums of products of quarters) in each draw: ``c`` actors x quarters, ``of`` draws x actors of labels from 0."""
    side = c.shape[1]
    out = {x: [np.zeros(len(of), dtype=int), np.zeros((len(of), side * side))] for x in range(labels)}
    for at in range(0, len(c), piece):
        part = c[at : at + piece]
        products = (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
        for x, sums in out.items():
            mine = of[:, at : at + piece] == x
            sums[0] += mine.sum(axis=1)
            sums[1] += mine.astype(float) @ products
    return {x: (n, k) for x, (n, k) in out.items()}


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """(test_year, *by, train, quarters, spread): of ``packed`` rows the sum of squares of all test values about their mean."""
    tests = rows.select("test_year", *by, "train", F.size("y").alias("quarters"), F.explode(F.slice("y", F.col("train") + 1, F.size("y"))).alias("v"))
    return tests.groupBy("test_year", *by, "train", "quarters").agg((F.var_pop("v") * F.count("v")).alias("spread"))


def basis(products: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(quarters x columns with these sums of products, the matrix that takes columns back to weights on quarters)."""
    values, vectors = np.linalg.eigh(products)
    most = np.argsort(values)[::-1][: min(n, len(values))]
    most = most[values[most] > values.max() * 1e-13] if values.max() > 0 else most[:0]
    root = np.sqrt(values[most])
    return vectors[:, most] * root, vectors[:, most] / root


def panel(products: dict[str, np.ndarray], n: dict[str, int]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(quarters x columns, block of each column, block -> its way back to weights)."""
    made = {b: basis(products[b], n[b]) for b in sorted(products)}
    return np.hstack([y for y, _ in made.values()]), np.concatenate([np.full(y.shape[1], b) for b, (y, _) in made.items()]), {b: back for b, (_, back) in made.items()}


def folded(pdf: pd.DataFrame) -> tuple[int, dict[str, int], dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(training quarters, sizes, totals, products by block) of one window's moments."""
    n, totals, products = {}, {}, {}
    for block, part in pdf.groupby("block"):
        n[block] = int(part["n"].sum())
        totals[block] = matrix(part["total"]).sum(axis=0)
        sums = matrix(part["products"]).sum(axis=0)
        products[block] = sums.reshape(int(round(len(sums) ** 0.5)), -1)
    return int(pdf["train"].iloc[0]), n, totals, products


_WEIGHTS = "test_year int, variant string, arch string, block string, train int, quarters int, weights array<double>"


def solved(rows: DataFrame, model: Model) -> dict[int, dict[str, dict[tuple[str, str], np.ndarray]]]:
    """test_year -> block -> (variant, architecture) -> weights (test quarters x quarters) of the window's ``packed`` rows.

    What comes to the driver doesn't grow with the actors: a matrix a window, block and architecture.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        train, n, _, products = folded(pdf)
        out = []
        if train >= 4 and len(next(iter(products.values()))) > train:
            y, block, back = panel(products, n)
            for (variant, arch), pred in model(y[:train], y[train:], block, n).items():
                out += [(int(key[0]), variant, arch, b, train, len(pred), (pred[:, block == b] @ back[b].T).ravel()) for b in back]
            out += [(int(key[0]), *_SLOPES, b, train, len(y) - train, kernels.pooled_slopes(y[:train], y[train:])) for b in back]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _WEIGHTS.split(", ")])

    found: dict = {}
    for r in moments(rows).groupBy("test_year").applyInPandas(one, _WEIGHTS).toLocalIterator():
        found.setdefault(r["test_year"], {}).setdefault(r["block"], {})[r["variant"], r["arch"]] = np.array(r["weights"]).reshape(r["quarters"], -1)
    return found


def _forecasts(part: pd.DataFrame, weights: dict[tuple[str, str], np.ndarray], own: Own | None) -> tuple[np.ndarray, dict[tuple[str, str], np.ndarray]]:
    """(actual values, forecasts by variant and architecture) of rows of one window and block: actors x test quarters."""
    y, train = matrix(part["y"]), int(part["train"].iloc[0])
    mean = y.mean(axis=1, keepdims=True)
    preds = {k: mean + (y - mean) @ w.T for k, w in weights.items() if k != _SLOPES}
    if own:
        preds |= {k: p.T for k, p in own(y.T, train, weights[_SLOPES][:, 0], int(part["test_year"].iloc[0])).items()}
    return y[:, train:], preds


_LONG = "test_year int, variant string, period date, actor long, block string, arch string, pred double, actual double"


def predictions(rows: DataFrame, weights: dict, quarters: dict[int, list], own: Own | None = None, piece: int = 2000) -> DataFrame:
    """(test_year, variant, period, actor, block, arch, pred, actual) of ``packed`` rows, a few thousand actors at a time."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (year, block), rest in batch.groupby(["test_year", "block"]):
                for at in range(0, len(rest) if year in weights else 0, piece):
                    part = rest[at : at + piece]
                    actual, preds = _forecasts(part, weights[year][block], own)
                    q, n = actual.shape[1], len(part)
                    for (variant, arch), p in preds.items():
                        yield pd.DataFrame({"test_year": year, "variant": variant, "period": np.tile(np.array(quarters[year], dtype=object), n), "actor": np.repeat(part["actor"].to_numpy(), q), "block": block, "arch": arch, "pred": p.ravel(), "actual": actual.ravel()})

    return rows.select("test_year", "actor", "block", "y", "train").mapInPandas(told, _LONG)


_SCORES = "test_year int, variant string, arch string, block string, sse double, sae double, total double, squares double, n long"


def scores(rows: DataFrame, weights: dict, by: list[str], own: Own | None = None) -> DataFrame:
    """(*by, r2, mae, n) as scoring.r_squared of ``predictions``, from each task's sums."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for (year, block), part in batch.groupby(["test_year", "block"]):
                if year in weights:
                    actual, preds = _forecasts(part, weights[year][block], own)
                    for (variant, arch), p in preds.items():
                        e = actual - p
                        key = (year, variant, arch, block)
                        found[key] = found.get(key, 0.0) + np.array([(e**2).sum(), np.abs(e).sum(), actual.sum(), (actual**2).sum(), actual.size])
        yield pd.DataFrame([(*key, *v[:4], int(v[4])) for key, v in found.items()], columns=[c.split()[0] for c in _SCORES.split(", ")])

    parts = rows.select("test_year", "block", "y", "train").mapInPandas(sums, _SCORES)
    n = F.sum("n")
    spread = F.sum("squares") - F.sum("total") ** 2 / n
    # Below this the spread is rounding of its two terms.
    r2 = F.when(spread > 1e-14 * F.sum("squares"), 1 - F.sum("sse") / spread).otherwise(F.lit(0.0))
    return parts.groupBy(*by).agg(r2.alias("r2"), (F.sum("sae") / n).alias("mae"), n.alias("n"))
