"""ε-insensitive regressions fitted together.

The primal ½|w|² + C·Σ max(0, |y - f(x)| - ε) is minimised by Newton steps on the
loss rounded over a width μ that shrinks until it changes the objective by less than
``tol`` of it, so a fit is within about that of the optimum.  A step needs sums over the
training rows only: one pass over the rows gives them to every fit of a grid, whatever
folds it trains on, and gives the sums at the full step along with the losses of the line search,
so that a step taken in full costs no second pass.  ``rbf`` maps the inputs to random Fourier
features of exp(-γ|x-x'|²) (Rahimi & Recht), γ='scale' = 1 / (p · Var(X)) over the fit's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import sized

#: Numbers that one pass sends to the driver, over all its partitions.
PASS_NUMBERS = 1 << 20
#: Step lengths that the line search tries at once, the full step first.
_STEPS = 0.5 ** np.arange(30)


@dataclass(frozen=True)
class Fit:
    """One regression: the parts of the rows that it trains on (told of a Column or an array) and its parameters."""
    trains_on: Callable
    C: float = 1.0
    epsilon: float = 0.1
    kernel: str = "linear"
    gamma: str | float = "scale"


@dataclass(frozen=True)
class Line:
    """Weights and intercept, on random Fourier features (omega, phase) if there are any."""
    w: np.ndarray
    b: float
    rff: tuple[np.ndarray, np.ndarray] | None = None

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """The features that the weights belong to, and ones."""
        if self.rff is not None:
            omega, phase = self.rff
            x = math.sqrt(2.0 / len(phase)) * np.cos(x @ omega.T + phase)
        return np.column_stack([x, np.ones(len(x))])


def _loss(r, eps, mu):
    """ε-insensitive loss of residuals, rounded to a parabola over ``mu``; its
    slope and whether a residual lies on the parabola."""
    u = np.abs(r) - eps
    on = (u > 0) & (u < mu)
    loss = np.where(on, u * u / (2 * mu), np.where(u >= mu, u - mu / 2, 0.0))
    return loss, np.where(on, u / mu, (u >= mu).astype(float)) * np.sign(r), on


def _sums(z, y, wb, eps, mu, step):
    """Gradient, Hessian, loss and true loss; with ``step`` those after the full
    step, and the losses at each of ``_STEPS`` along it."""
    r = y - z @ (wb if step is None else wb + _STEPS[0] * step)
    loss, slope, on = _loss(r, eps, mu)
    out = [-(z.T @ slope), (z[on].T @ z[on]).ravel() / mu, [loss.sum(), np.maximum(np.abs(r) - eps, 0).sum()]]
    if step is not None:
        r, along = y - z @ wb, z @ step
        out.append([_loss(r - t * along, eps, mu)[0].sum() for t in _STEPS])
    return np.concatenate(out)


def _newton(k: int, c: float, tol: float, max_iter: int) -> Generator[tuple, np.ndarray, tuple[np.ndarray, float]]:
    """Asks for the sums at (weights and intercept, mu, step) and returns the optimum."""
    wb, mu, steps = np.zeros(k + 1), 1.0, 0
    got = yield wb, mu, None
    while True:
        if not np.isfinite(got).all():
            raise RuntimeError("SVR: a training row has a NULL, NaN or infinite value")
        grad = c * got[:k + 1] + np.append(wb[:k], 0.0)
        hess = c * got[k + 1:-2].reshape(k + 1, k + 1) + np.diag(np.append(np.ones(k), 0.0))
        value = 0.5 * wb[:k] @ wb[:k] + c * got[-2]
        hess[k, k] += 0.1 * c / mu  # without a row on the parabola the bias has no curvature
        step = -np.linalg.solve(hess, grad)
        if -grad @ step / 2 <= 0.1 * tol * value + 1e-15:  # the decrease that Newton's model still has
            true = 0.5 * wb[:k] @ wb[:k] + c * got[-1]
            if true - value <= tol * true + 1e-12:  # the rounded objective is nowhere above the true one
                return wb[:k], wb[k]
            mu /= 4
            got = yield wb, mu, None
            continue
        if steps >= max_iter:
            raise RuntimeError(f"SVR: no convergence in {max_iter} steps")
        steps += 1
        got = yield wb, mu, step
        got, losses = got[:-len(_STEPS)], got[-len(_STEPS):]
        values = np.array([0.5 * x @ x for x in wb[:k] + _STEPS[:, None] * step[:k]]) + c * losses
        best = int(values.argmin())
        if values[best] >= value:  # below rounding error
            raise RuntimeError("SVR: no step lessens the objective")
        wb = wb + _STEPS[best] * step
        if best:
            got = yield wb, mu, None


class Rows:
    """The rows of a panel, cached for the passes: features, label and the part that each row belongs to.
    Rows without a label are left out."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, part: Column | None = None):
        self.names = [f"_x{i}" for i in range(len(features))]
        cols = [F.col(c).cast("double").alias(n) for c, n in zip(features, self.names)]
        rows = df.select(*cols, F.col(label).cast("double").alias("_y"), (F.lit(0) if part is None else part).cast("int").alias("_part"))
        small, self.read = sized(rows.filter("_y is not null"))
        self.rows = small.cache()
        self.n_partitions = self.rows.select(F.spark_partition_id()).distinct().count()

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()
        self.read.unpersist()

    def sums(self, requests: list[Callable]) -> list[np.ndarray]:
        """The sum over all rows of what each request makes of (x, y, part) arrays."""
        names = self.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                x, y, part = pdf[names].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float), pdf["_part"].to_numpy()
                got = [request(x, y, part) for request in requests]
                total = got if total is None else [a + b for a, b in zip(total, got)]
            if total is not None:
                yield pd.DataFrame({"request": range(len(total)), "sums": [t.tolist() for t in total]})

        out: list = [0.0] * len(requests)
        for row in self.rows.mapInPandas(run, "request int, sums array<double>").collect():
            out[row["request"]] = out[row["request"]] + np.array(row["sums"], float)  # a NaN arrives as NULL
        return out

    def _spread(self, fits: Sequence[Fit]) -> list[tuple[int, float, float]]:
        """Rows, mean and deviation of the label over each fit's rows."""
        part, y = F.col("_part"), F.col("_y")
        used = [F.when(f.trains_on(part), y) for f in fits]
        got = self.rows.agg(*[F.struct(F.count(c), F.avg(c), F.stddev_pop(c)).alias(f"f{i}") for i, c in enumerate(used)]).first()
        return [(n, m or 0.0, s or 1.0) for n, m, s in got]

    def _gammas(self, fits: Sequence[Fit]) -> list[float]:
        """γ of each fit on random Fourier features."""
        found = [f.gamma for f in fits]
        scaled = [i for i, f in enumerate(fits) if f.kernel == "rbf" and f.gamma == "scale"]
        if scaled:
            long = self.rows.select("_part", F.explode(F.array(*self.names)).alias("v"))
            got = long.agg(*[F.var_pop(F.when(fits[i].trains_on(F.col("_part")), F.col("v"))).alias(f"f{i}") for i in scaled]).first()
            for i, v in zip(scaled, got):
                found[i] = 1.0 / (len(self.names) * (v or 1.0))
        return found

    def fit(self, fits: Sequence[Fit], n_components: int, max_iter: int, tol: float, seed: int) -> list[Line]:
        """All ``fits``, a Newton step of each in one pass."""
        out: list[Line] = []
        spreads, newtons, asked = self._spread(fits), {}, {}
        for i, (f, gamma, (n, _, s)) in enumerate(zip(fits, self._gammas(fits), spreads)):
            rff = None
            if f.kernel == "rbf":
                rng = np.random.default_rng(seed)
                rff = (rng.normal(scale=math.sqrt(2 * gamma), size=(n_components, len(self.names))), rng.uniform(0, 2 * math.pi, size=n_components))
            k = n_components if rff else len(self.names)
            out.append(Line(np.zeros(k), 0.0, rff))
            if n:
                # Standardised label: ½|w'|² + (C/s)·Σ max(0, |y' - f'| - ε/s) is the
                # original objective divided by s², so the minimiser maps back exactly
                # (w = s·w', b = s·b' + mean); it only makes fixed step sizes sensible.
                newtons[i] = _newton(k, f.C / s, tol, max_iter)
                asked[i] = next(newtons[i])

        def request(i, wb, mu, step):
            trains_on, line, eps, (_, m, s) = fits[i].trains_on, out[i], fits[i].epsilon / spreads[i][2], spreads[i]

            def run(x, y, part):
                on = trains_on(part)
                return _sums(line.inputs(x[on]), (y[on] - m) / s, wb, eps, mu, step)

            return run

        while asked:
            now = [next(iter(asked))]
            size = 0
            for i in list(asked)[1:]:
                size += len(asked[i][0]) ** 2 * self.n_partitions
                if size > PASS_NUMBERS:
                    break
                now.append(i)
            for i, got in zip(now, self.sums([request(i, *asked[i]) for i in now])):
                del asked[i]  # those left over for want of room come first in the next pass
                try:
                    asked[i] = newtons[i].send(got)
                except StopIteration as done:
                    w, b = done.value
                    _, m, s = spreads[i]
                    out[i] = Line(w * s, b * s + m, out[i].rff)
        for i, (n, m, _) in enumerate(spreads):
            if not n:
                out[i] = Line(out[i].w, m, out[i].rff)
        return out

    def rmse(self, lines: Sequence[Line], held_out: Sequence[Callable]) -> list[float]:
        """Root mean squared error of each line on its held-out parts."""
        def request(line, tests_on):
            def run(x, y, part):
                on = tests_on(part)
                r = y[on] - line.inputs(x[on]) @ np.append(line.w, line.b)
                return np.array([r @ r, len(r)])

            return run

        got = self.sums([request(line, use) for line, use in zip(lines, held_out)])
        if any(np.ndim(g) == 0 or not g[1] for g in got):
            raise ValueError("a fold has no rows to score")
        return [math.sqrt(g[0] / g[1]) for g in got]


class Held(Rows):
    """Rows at hand as arrays: a pass over them is no job."""

    def __init__(self, x: np.ndarray, y: np.ndarray, part: np.ndarray):
        self.names, self.n_partitions = [f"_x{i}" for i in range(x.shape[1])], 1
        self.x, self.y, self.part = x, y, part

    def __exit__(self, *_) -> None:
        pass

    def sums(self, requests: list[Callable]) -> list[np.ndarray]:
        return [request(self.x, self.y, self.part) for request in requests]

    def _spread(self, fits: Sequence[Fit]) -> list[tuple[int, float, float]]:
        used = [self.y[f.trains_on(self.part)] for f in fits]
        return [(len(y), float(y.mean()) or 0.0, float(y.std()) or 1.0) if len(y) else (0, 0.0, 1.0) for y in used]

    def _gammas(self, fits: Sequence[Fit]) -> list[float]:
        found = []
        for f in fits:
            values = self.x[f.trains_on(self.part)]
            scaled = f.kernel == "rbf" and f.gamma == "scale"
            found.append(1.0 / (len(self.names) * (values.size and float(values.var()) or 1.0)) if scaled else f.gamma)
        return found
