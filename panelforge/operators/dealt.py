"""A grid search dealt out over tasks.

The fits of a grid are many and a panel's rows mostly few.  If the rows fit in one partition
(``TASK_ROWS``), they go to every task and each fit is a task of its own; a distributed fit would
start a job for each level of each tree, with next to nothing in it.  Cells that differ in their
number of trees only share one fit: the first n trees of a longer fit are the fit of n trees.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import svr, trees

#: Rows that go to every task at most: those of one partition of ``session.sized``.
TASK_ROWS = 10_000
#: The parameter that counts the trees of a model.
COUNT = {"Random Forest": "n_estimators", "XGBoost": "n_estimators", "CatBoost": "iterations"}


@dataclass(frozen=True)
class Held:
    """Rows of a panel as arrays, ordered by their values; ``null`` tells a NULL feature from a NaN."""
    x: np.ndarray
    null: np.ndarray
    y: np.ndarray
    part: np.ndarray

    def only(self, on: np.ndarray) -> Held:
        return Held(self.x[on], self.null[on], self.y[on], self.part[on])


def held(df: DataFrame, features: Sequence[str], label: str, part: Column) -> Held | None:
    """The rows of ``df`` that have a label; None if they are more than ``TASK_ROWS``."""
    cols = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    rows = df.select(part.cast("int").alias("_part"), F.col(label).cast("double").alias("_y"), *cols).filter("_y is not null")
    found = rows.limit(TASK_ROWS + 1).collect()
    if len(found) > TASK_ROWS:
        return None
    values = np.array([tuple(r) for r in found], dtype=object).reshape(len(found), 2 + len(features))
    null = np.array(np.equal(values, None), bool)
    numbers = np.where(null, np.nan, values).astype(float)
    order = np.lexsort(np.hstack([null[:, 2:], numbers]).T[::-1])
    numbers, null = numbers[order], null[order]
    return Held(numbers[:, 2:], null[:, 2:], numbers[:, 1], numbers[:, 0])


def deal(spark, rows: Held, jobs: Sequence, run: Callable) -> list:
    """``run(rows, job)`` of every job, each in a task."""
    shared = spark.sparkContext.broadcast(rows)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"job": [i], "made": [pickle.dumps(run(shared.value, jobs[i]))]})

    got = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(task, "job long, made binary").collect()
    shared.destroy()
    return [pickle.loads(r["made"]) for r in sorted(got, key=lambda r: r["job"])]


# ------------------------------------------------------------------- models
@dataclass(frozen=True)
class Symmetric:
    """Symmetric trees over the borders of their features."""
    borders: list
    base: float
    trees: list


def _complete(rows: Held) -> Held:
    if np.isnan(rows.x).any() or np.isnan(rows.y).any():
        raise ValueError("a row has a NULL or NaN feature or label")
    return rows


def _share(strategy, p: int) -> int:
    """Features that a node may split on (``featureSubsetStrategy`` of pyspark.ml)."""
    return math.ceil(math.sqrt(p)) if strategy == "sqrt" else min(p, math.ceil(float(strategy) * p))


def fit(name: str, params: dict, rows: Held, seed: int):
    """The model of one cell on all of ``rows``: a :class:`trees.Trees`, :class:`Symmetric` or :class:`svr.Line`."""
    if not len(rows.y):
        raise ValueError("no rows to fit on")
    p = rows.x.shape[1]
    if name == "SVR":
        with svr.Held(rows.x, rows.y, rows.part) as data:
            return data.fit([svr.Fit(lambda part: part == part, float(params.get("C", 1.0)), float(params.get("epsilon", 0.1)),
                                     params.get("kernel", "linear"))], n_components=100, max_iter=500, tol=1e-3, seed=seed)[0]
    n = int(params[COUNT[name]])
    if name == "CatBoost":
        borders = trees.quantile_borders(rows.x, rows.null, 32)
        bins = trees.border_bins(rows.x, rows.null, borders)
        found = trees.symmetric(bins, np.array([len(b) for b in borders]), rows.y, n, int(params["depth"]),
                                float(params["learning_rate"]), float(params.get("l2_leaf_reg", 3.0)))
        return Symmetric(borders, *found)
    x, y = _complete(rows).x, rows.y
    if name == "Random Forest":
        depth = 30 if params.get("max_depth") is None else int(params["max_depth"])
        least = max(1, math.ceil(int(params.get("min_samples_split", 2)) / 2))
        return trees.forest(x, y, n, depth, least, _share(params.get("max_features", "sqrt"), p), seed)
    if name == "XGBoost":
        return trees.boosted(x, y, n, int(params["max_depth"]), float(params["learning_rate"]), float(params.get("subsample", 1.0)),
                             _share(params.get("colsample_bytree", 1.0), p), seed)
    raise KeyError(f"unknown model {name!r}")


def predicted(name: str, model, rows: Held, counts: Sequence[int]) -> list[np.ndarray]:
    """Predictions of the model's first n trees, for each n of ``counts``."""
    if name == "SVR":
        return [model.inputs(rows.x) @ np.append(model.w, model.b)]
    if name == "CatBoost":
        values = trees.symmetric_leaves(trees.border_bins(rows.x, rows.null, model.borders), model.trees)
        return [model.base + values[:n].sum(axis=0) for n in counts]
    values = model.leaves(_complete(rows).x)
    if name == "Random Forest":
        return [values[:n].mean(axis=0) for n in counts]
    return [model.weight[:n] @ values[:n] for n in counts]


# -------------------------------------------------------------- grid search
def chains(name: str, cells: Sequence[dict]) -> list[list[int]]:
    """Numbers of the cells that share a fit, the one with most trees last."""
    count = COUNT.get(name)
    found: dict = {}
    for i, c in enumerate(cells):
        found.setdefault(i if count is None else repr(sorted((k, v) for k, v in c.items() if k != count)), []).append(i)
    return [sorted(c, key=lambda i: cells[i][count]) if count else c for c in found.values()]


def scores(spark, name: str, cells: Sequence[dict], rows: Held, n_folds: int, trains_on: Callable, seed: int) -> list[list[float]]:
    """The held-out RMSE of every cell, by fold; ``trains_on(part, fold)`` marks a fold's training rows."""
    jobs = [(chain, f) for chain in chains(name, cells) for f in range(n_folds)]

    def run(rows: Held, job: tuple) -> list[float]:
        chain, f = job
        out = rows.only(rows.part == f)
        if not len(out.y):
            raise ValueError("a fold has no rows to score")
        model = fit(name, cells[chain[-1]], rows.only(trains_on(rows.part, f)), seed)
        found = predicted(name, model, out, [int(cells[i][COUNT[name]]) for i in chain] if name in COUNT else [0])
        return [float(np.sqrt(np.mean((out.y - p) ** 2))) for p in found]

    rmse: list = [[None] * n_folds for _ in cells]
    for (chain, f), found in zip(jobs, deal(spark, rows, jobs, run)):
        for i, r in zip(chain, found):
            rmse[i][f] = r
    return rmse


def refit(spark, name: str, params: dict, rows: Held, seed: int):
    """:func:`fit` of one cell, in a task."""
    return deal(spark, rows, [params], lambda rows, params: fit(name, params, rows, seed))[0]
