"""Linear models from one aggregate of the table.

Least squares, ridge and lasso depend on the rows only through counts, means and covariances. These are
taken once per fold, in one pass; every fold and every penalty is then solved from small matrices, and the
score on held-out rows follows from the same matrices. The table is read once, however many settings and
folds there are; what comes to the driver is folds x features x features numbers.

Rows with a NULL in a feature or in the target are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINEAR_MODELS = ("linear", "ridge", "lasso")


class Moments(NamedTuple):
    """Count, means and covariances of (features, target); the target comes last."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        """The moments of both sets of rows."""
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        between = np.outer(gap, gap) * (self.n * other.n / n**2)
        return Moments(n, mean, (self.n * self.cov + other.n * other.cov) / n + between)


class Fitted(NamedTuple):
    """Weights of the features and the intercept."""

    weights: np.ndarray
    intercept: float

    def column(self, features: Sequence[str]) -> Column:
        """The prediction as a column expression."""
        total = F.lit(float(self.intercept))
        for name, weight in zip(features, self.weights.tolist(), strict=True):
            total = total + F.col(name) * F.lit(weight)
        return total


def moments(rows: DataFrame, features: Sequence[str], target: str, fold: Column) -> dict[int, Moments]:
    """Moments of each fold; one aggregate that combines before its shuffle."""
    names = [*features, target]
    whole = F.lit(True)
    for name in names:
        whole &= F.col(name).isNotNull()
    values = [F.col(name).cast("double").alias(f"v{i}") for i, name in enumerate(names)]
    numbers = rows.filter(whole).select(fold.alias("_fold"), *values)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = numbers.groupBy("_fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"v{i}") for i in range(len(names))]).alias("mean"),
        F.array(*[F.covar_pop(f"v{i}", f"v{j}") for i, j in pairs]).alias("cov"),
    )
    out = {}
    for row in found.collect():  # one row a fold
        cov = np.zeros((len(names), len(names)))
        for (i, j), value in zip(pairs, row["cov"], strict=True):
            cov[i, j] = cov[j, i] = value
        out[row["_fold"]] = Moments(row["n"], np.array(row["mean"]), cov)
    return out


def _lasso(cov: np.ndarray, target: np.ndarray, alpha: float, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on w cov w / 2 - target w + alpha |w|."""
    w = np.zeros(len(target))
    scale = np.sqrt(max(np.abs(target).max(initial=0.0), 1e-300))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(w)):
            if cov[k, k] <= 0:
                continue
            rest = target[k] - cov[k] @ w + cov[k, k] * w[k]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / cov[k, k]
            moved = max(moved, abs(new - w[k]) * np.sqrt(cov[k, k]))
            w[k] = new
        if moved <= 1e-12 * scale:
            break
    return w


def solve(name: str, known: Moments, alpha: float | None = None) -> Fitted:
    """The model of some rows: ridge minimises RSS + alpha |w|^2, lasso RSS / 2n + alpha |w|."""
    cov, target = known.cov[:-1, :-1], known.cov[:-1, -1]
    if name == "linear":
        weights = np.linalg.lstsq(cov, target, rcond=None)[0]
    elif name == "ridge":
        penalty = (1.0 if alpha is None else alpha) / known.n
        weights = np.linalg.lstsq(cov + penalty * np.eye(len(target)), target, rcond=None)[0]
    elif name == "lasso":
        weights = _lasso(cov, target, 1.0 if alpha is None else alpha)
    else:
        raise ValueError(f"{name} is none of {', '.join(LINEAR_MODELS)}")
    return Fitted(weights, float(known.mean[-1] - weights @ known.mean[:-1]))


def score(model: Fitted, held_out: Moments) -> float:
    """R2 of a model on the rows of some moments."""
    w = model.weights
    cov, target, own = held_out.cov[:-1, :-1], held_out.cov[:-1, -1], held_out.cov[-1, -1]
    shift = held_out.mean[-1] - model.intercept - w @ held_out.mean[:-1]
    residual = own - 2 * w @ target + w @ cov @ w + shift**2
    return float(1 - residual / own) if own > 0 else float("nan")


def cross_validated(
    name: str, folds: Mapping[int, Moments], settings: Sequence[Mapping[str, float]]
) -> list[float]:
    """Mean held-out R2 of each setting over the folds."""
    if len(folds) < 2:
        raise ValueError("cross-validation needs rows in two folds")
    rest = {}
    for fold in folds:
        total = Moments(0, np.zeros(0), np.zeros((0, 0)))
        for other, known in folds.items():
            if other != fold:
                total = total + known
        rest[fold] = total
    return [
        float(np.mean([score(solve(name, rest[f], s.get("alpha")), folds[f]) for f in sorted(folds)]))
        for s in settings
    ]


def fit(name: str, rows: DataFrame, features: Sequence[str], target: str, alpha: float | None = None) -> Fitted:
    """A model of all rows."""
    found = moments(rows, features, target, F.lit(0))
    if not found:
        raise ValueError("there are no rows to fit")
    return solve(name, found[0], alpha)
