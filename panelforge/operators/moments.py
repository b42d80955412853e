"""Ridge and Lasso from additive moments.

The cross products of (1, features, label) over a set of rows are all that a linear
least-squares fit and its squared error need, and they add up: the training set of
any fold is a sum of parts.  One aggregate by part therefore serves a whole grid with all
its folds; what is left is k x k algebra on the driver.  Columns are shifted by their overall
means before they are multiplied, so that large offsets cost no digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Cross products of (1, x - center, y - center) over some rows."""
    products: np.ndarray
    center: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.products + other.products, self.center)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.products - other.products, self.center)

    @property
    def n(self) -> float:
        return float(self.products[0, 0])

    def centered(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariance sums of the features, and with the label, about their own means."""
        if not self.n:
            raise ValueError("no rows to fit on")
        s = self.products[0, 1:]
        c = self.products[1:, 1:] - np.outer(s, s) / self.n
        return c[:-1, :-1], c[:-1, -1]

    def intercept(self, w: np.ndarray) -> float:
        """The intercept that goes with weights ``w``, for columns as they are."""
        means = self.products[0, 1:] / self.n + self.center
        return float(means[-1] - w @ means[:-1])

    def squared_error(self, w: np.ndarray, b: float) -> float:
        """Sum of (y - b - w·x)² over the rows."""
        v = np.concatenate([[self.center[-1] - b - w @ self.center[:-1]], -w, [1.0]])
        return max(float(v @ self.products @ v), 0.0)


def moments_by(df: DataFrame, features: Sequence[str], label: str, part: Column | None = None) -> dict:
    """{part: :class:`Moments`} of the rows of each part (one part, None, unless given).
    A NULL or NaN feature or label is an error, as for the other models."""
    cols = [*features, label]
    values = [F.col(c).cast("double") for c in cols]
    bad = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) for v in values])
    first = df.agg(F.count_if(bad).alias("bad"), *[F.avg(v).alias(f"c{i}") for i, v in enumerate(values)]).first()
    if first["bad"]:
        raise ValueError(f"{first['bad']} rows have a NULL or NaN in {cols}")
    center = np.array([first[f"c{i}"] or 0.0 for i in range(len(cols))])
    z = [F.lit(1.0), *[v - F.lit(float(c)) for v, c in zip(values, center)]]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    rows = df.select((F.lit(None).cast("int") if part is None else part).alias("_part"), *[x.alias(f"_z{i}") for i, x in enumerate(z)])
    sums = rows.groupBy("_part").agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"s_{i}_{j}") for i, j in pairs])
    out = {None: Moments(np.zeros((len(z), len(z))), center)} if part is None else {}
    for r in sums.collect():
        m = np.empty((len(z), len(z)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s_{i}_{j}"]
        out[r["_part"]] = Moments(m, center)
    return out


def ridge(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of least ‖y - Xw - b‖² + alpha ‖w‖²."""
    xx, xy = m.centered()
    w = np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0]
    return w, m.intercept(w)


def lasso(m: Moments, alpha: float, max_iter: int = 100_000, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """Weights and intercept of least ‖y - Xw - b‖² / 2n + alpha ‖w‖₁, by coordinate descent
    on the cross products until a sweep moves no fitted value by more than ``tol`` of the label's spread."""
    xx, xy = m.centered()
    size, w = np.diag(xx).copy(), np.zeros(len(xy))
    s = m.products[0, -1]
    spread = np.sqrt(max(m.products[-1, -1] - s * s / m.n, 0.0))
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(size > 0):
            rest = xy[j] - xx[j] @ w + size[j] * w[j]
            new = np.sign(rest) * max(abs(rest) - m.n * alpha, 0.0) / size[j]
            moved, w[j] = max(moved, abs(new - w[j]) * np.sqrt(size[j])), new
        if moved <= tol * spread:
            break
    return w, m.intercept(w)


FITS = {"Ridge": ridge, "Lasso": lasso}


def fold_moments(folds: DataFrame, features: Sequence[str], label: str, n_folds: int, kind: str) -> tuple[list[tuple[Moments, Moments]], Moments]:
    """(train, test) moments of every fold, and those of all rows, in one pass: training rows are
    all folds but one (``kfold``), or the first stretch and all tests before (``timeseries``)."""
    if kind == "kfold":
        parts = moments_by(folds, features, label, F.col("fold"))
        whole = reduce(lambda a, b: a + b, parts.values())
        return [(whole - parts[f], parts[f]) for f in range(n_folds) if f in parts], whole
    once = folds.filter("role = 'test' OR fold = 0")
    parts = moments_by(once, features, label, F.when(F.col("role") == "test", F.col("fold")).otherwise(-1))
    pairs, train = [], parts[-1]
    for f in range(n_folds):
        pairs.append((train, parts[f]))
        train = train + parts[f]
    return pairs, train
