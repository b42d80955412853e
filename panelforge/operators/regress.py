"""Regression models, grid search and evaluation (ML2-ML14).

Forests and gradient-boosted trees are ``pyspark.ml``; Ridge and Lasso are
solved from additive moments, a whole grid in one pass.  Linear SVR (and its RBF variant through
random Fourier features) has no Spark estimator: it is fitted by Newton steps
(:mod:`panelforge.operators.svr`), each one a distributed aggregate over the cached
rows that serves all fits of a grid, the k+1 parameters of each living on the driver.
The grids of SVR and of the tree families over a panel that fits in one partition are dealt
out over tasks, a fit each (:mod:`panelforge.operators.dealt`).

Parameter mapping to the reference estimators, checked numerically:
* Ridge(alpha), Lasso(alpha) -> solved from cross products
  (:mod:`panelforge.operators.moments`), the same objectives
* RandomForest  -> RandomForestRegressor; max_depth None -> 30 (Spark's
  limit); min_samples_split s -> minInstancesPerNode ceil(s/2).
* XGBoost role  -> GBTRegressor (no second-order / lambda term).
* CatBoost role -> oblivious (symmetric) boosted trees with L2 leaf
  regularisation fitted by DataFrame aggregations (:func:`fit_oblivious`);
  ordered boosting is not reproduced.
"""

from __future__ import annotations

import itertools
import json
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import dealt, svr
from panelforge.operators.moments import FITS, fold_moments, moments_by
from panelforge.operators.trees import Trees

FEATURES = "_features"
# So many symmetric trees become an expression each; more are looped over.
MAX_INLINE_TREES = 32

# The reference hyper-parameter grids (sizes 6, 6, 24, 72, 48, 36).
PARAM_GRIDS = {
    "Ridge": {"alpha": [0.01, 0.1, 1, 10, 100, 1000]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1, 10, 100]},
    "SVR": {"C": [0.1, 1, 10, 100], "epsilon": [0.1, 0.5, 1.0], "kernel": ["linear", "rbf"]},
    "Random Forest": {"n_estimators": [100, 200, 300], "max_depth": [5, 10, 15, None],
                      "min_samples_split": [2, 5, 10], "max_features": ["sqrt", 0.5]},
    "XGBoost": {"n_estimators": [100, 200], "max_depth": [2, 3, 4], "learning_rate": [0.05, 0.1],
                "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "CatBoost": {"iterations": [200, 400], "depth": [3, 4, 5], "learning_rate": [0.05, 0.1],
                 "l2_leaf_reg": [3, 7, 15]},
}

# For tests and quick runs: the whole grids of the linear models (one pass over the
# rows), one cell of each of the others.
SMALL_GRIDS = {
    "Ridge": PARAM_GRIDS["Ridge"],
    "Lasso": PARAM_GRIDS["Lasso"],
    "SVR": {"C": [10], "epsilon": [0.1], "kernel": ["linear"]},
    "Random Forest": {"n_estimators": [20], "max_depth": [5], "min_samples_split": [2],
                      "max_features": ["sqrt"]},
    "XGBoost": {"n_estimators": [20], "max_depth": [3], "learning_rate": [0.1],
                "subsample": [1.0], "colsample_bytree": [1.0]},
    "CatBoost": {"iterations": [10], "depth": [4], "learning_rate": [0.2], "l2_leaf_reg": [7]},
}

SEED = 42


def grid_cells(grid: dict) -> list:
    """Exhaustive list of parameter dicts (ParamGridBuilder order)."""
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES,
                           handleInvalid="error").transform(df)


# ----------------------------------------------------------------------- SVR
class LinearExprModel:
    """Linear model evaluated as a column expression (b + Σ w·z), z the
    inputs or their random Fourier features: fitted SVR, or fixed
    coefficients for scoring."""

    def __init__(self, features, w, b, rff=None):
        self.features, self.w, self.b, self.rff = list(features), np.asarray(w), float(b), rff

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.w)

    @property
    def intercept(self) -> float:
        return self.b

    def predict_expr(self) -> Column:
        xs = [F.col(c).cast("double") for c in self.features]
        if self.rff is None:
            return sum((x * F.lit(float(wi)) for x, wi in zip(xs, self.w)), F.lit(self.b))
        # a loop over one constant array: an expression for each component outgrows a Java method
        omega, phase = self.rff
        scale = math.sqrt(2.0 / len(phase))
        text = json.dumps([{"o": o.tolist(), "p": float(p), "w": scale * float(wi)} for o, p, wi in zip(omega, phase, self.w)])
        components = F.from_json(F.lit(text), "array<struct<o:array<double>,p:double,w:double>>")
        angle = lambda c: F.aggregate(F.zip_with(F.array(*xs), c["o"], lambda x, o: x * o), c["p"], lambda total, v: total + v)
        return F.aggregate(components, F.lit(self.b), lambda total, c: total + c["w"] * F.cos(angle(c)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.predict_expr())


def fit_svr(train: DataFrame, features, label: str, C: float = 1.0, epsilon: float = 0.1,
            kernel: str = "linear", gamma="scale", n_components: int = 100,
            max_iter: int = 500, tol: float = 1e-3, seed: int = SEED) -> LinearExprModel:
    """One ε-insensitive regression (:mod:`panelforge.operators.svr`);
    RuntimeError if ``max_iter`` Newton steps are not enough."""
    features = list(features)
    with svr.Rows(train, features, label) as rows:
        line = rows.fit([svr.Fit(lambda part: part >= 0, C, epsilon, kernel, gamma)], n_components, max_iter, tol, seed)[0]
    return LinearExprModel(features, line.w, line.b, line.rff)


# ------------------------------------------------- oblivious boosting (ML7 v2)
class ObliviousBoostModel:
    """Symmetric (oblivious) trees: every level of a tree uses one
    (feature, threshold) split, so a leaf index is Σ_d 2^(D-1-d)·[x_f > t].
    Prediction = base + Σ_trees value[leaf] as one column expression."""

    def __init__(self, features, base, trees):
        self.features, self.base, self.trees = list(features), float(base), trees

    @staticmethod
    def leaf_expr(splits) -> Column:
        """Leaf index of a row; a NULL feature goes left (0)."""
        leaf = F.lit(0)
        for f, thr in splits:
            leaf = leaf * 2 + F.when(F.coalesce(F.col(f).cast("double") > F.lit(thr), F.lit(False)),
                                     1).otherwise(0)
        return leaf

    def predict_expr(self) -> Column:
        if len(self.trees) > MAX_INLINE_TREES:
            return self._looped()
        out = F.lit(self.base)
        for splits, values in self.trees:
            out = out + F.element_at(F.array(*[F.lit(float(v)) for v in values]), self.leaf_expr(splits) + 1)
        return out

    def _looped(self) -> Column:
        """The same sum as a loop over one constant array of trees."""
        at = {f: i + 1 for i, f in enumerate(self.features)}
        text = json.dumps([{"s": [{"f": at[f], "t": float(t)} for f, t in splits], "v": [float(v) for v in values]} for splits, values in self.trees])
        trees = F.from_json(F.lit(text), "array<struct<s:array<struct<f:int,t:double>>,v:array<double>>>")
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        leaf = lambda splits: F.aggregate(splits, F.lit(0), lambda at, s: at * 2 + F.when(
            F.coalesce(F.element_at(x, s["f"]) > s["t"], F.lit(False)), 1).otherwise(0))
        return F.aggregate(trees, F.lit(self.base), lambda total, tree: total + F.element_at(tree["v"], leaf(tree["s"]) + 1))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.predict_expr())


class TreesModel:
    """A forest or boosted trees (:mod:`panelforge.operators.trees`), their weighted sum the prediction.
    A NULL or NaN feature raises."""

    def __init__(self, features, trees: Trees):
        self.features, self.trees = list(features), trees

    def transform(self, df: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                if np.isnan(x).any():
                    raise ValueError("a row has a NULL or NaN feature")
                yield pd.Series(trees.predict(x))

        return df.withColumn("prediction", predict(*[F.col(c).cast("double") for c in self.features]))

    def table(self, spark) -> DataFrame:
        """A row per node; a root has its tree's weight."""
        t = self.trees
        weight = np.concatenate([t.weight, np.full(len(t.feature) - len(t.weight), np.nan)])
        columns = zip(t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.right.tolist(), t.value.tolist(), weight.tolist())
        return spark.createDataFrame([(i, *c) for i, c in enumerate(columns)],
                                     "node int, feature int, cut double, left int, right int, value double, weight double")

    @classmethod
    def from_table(cls, features, df: DataFrame) -> TreesModel:
        c = [np.array(v) for v in zip(*df.orderBy("node").drop("node").collect())]
        return cls(features, Trees(*c[:5], c[5][~np.isnan(c[5])]))


def fit_oblivious(train: DataFrame, features, label: str, iterations: int = 200, depth: int = 6,
                  learning_rate: float = 0.1, l2_leaf_reg: float = 3.0, border_count: int = 32,
                  cut_every: int = 10) -> ObliviousBoostModel:
    """Gradient boosting of oblivious trees for squared error (CatBoost's
    tree shape and L2 leaf regularisation; ordered boosting is not
    reproduced).  Features are binned once on approximate quantile
    borders; each level is ONE grouped aggregate of residual sums and
    counts per (leaf, feature, bin) — at most 2^depth x p x bins numbers
    reach the driver — and the split maximising Σ G²/(n + λ) over the
    current leaves is shared by the whole level.  Leaf values are
    lr · G / (n + λ).  The running prediction is a column; the lineage is
    cut (reliable checkpoint) every ``cut_every`` trees."""
    from panelforge.session import cut_lineage
    features = list(features)
    p = len(features)
    probs = [k / border_count for k in range(1, border_count)]
    qs = train.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(c)
                     for c in features]).first()
    borders = [sorted(set(float(v) for v in (qs[c] or []) if v is not None)) for c in features]
    bins = [sum((F.when(F.col(c).cast("double") > F.lit(b), 1).otherwise(0) for b in borders[i]), F.lit(0))
            .alias(f"_b{i}") for i, c in enumerate(features)]
    data = train.select(*bins, F.col(label).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    base = data.agg(F.avg("_y")).first()[0] or 0.0
    data = cut_lineage(data.withColumn("_p", F.lit(base))).cache()
    trees, pending = [], []
    bcols = [f"_b{i}" for i in range(p)]
    for it in range(iterations):
        g = F.col("_y") - (F.col("_p") + sum((_leaf_out(sp, vals) for sp, vals in pending), F.lit(0.0)))
        leaf = F.lit(0)
        splits = []
        last = None
        for level in range(depth):
            long = data.select(leaf.alias("_leaf"), g.alias("_g"), *bcols).unpivot(
                ["_leaf", "_g"], bcols, "_f", "_bin")
            rows = long.groupBy("_leaf", "_f", "_bin").agg(F.sum("_g").alias("G"),
                                                          F.count(F.lit(1)).alias("n")).collect()
            best = _best_split(rows, p, [len(b) for b in borders], l2_leaf_reg)
            if best is None:
                break
            fi, t = best
            splits.append((fi, t))
            leaf = leaf * 2 + F.when(F.col(f"_b{fi}") > t, 1).otherwise(0)
            last = (rows, fi, t)
        if not splits:
            break
        # leaf sums come from the last level's aggregate: child 2·leaf (+1)
        # takes the bins <= t (> t) of the chosen feature — no extra pass
        rows, fi, t = last
        sums = {}
        for r in rows:
            if int(r["_f"][2:]) != fi:
                continue
            child = 2 * r["_leaf"] + (1 if r["_bin"] > t else 0)
            gs, ns = sums.get(child, (0.0, 0))
            sums[child] = (gs + r["G"], ns + r["n"])
        values = [learning_rate * sums[k][0] / (sums[k][1] + l2_leaf_reg) if k in sums else 0.0
                  for k in range(2 ** len(splits))]
        pending.append((splits, values))
        trees.append(([(features[fi], borders[fi][t]) for fi, t in splits], values))
        if len(pending) >= cut_every or it == iterations - 1:
            add = sum((_leaf_out(sp, vals) for sp, vals in pending), F.lit(0.0))
            old = data
            data = cut_lineage(data.withColumn("_p", F.col("_p") + add)).cache()
            old.unpersist()
            pending = []
    data.unpersist()
    return ObliviousBoostModel(features, base, trees)


def _leaf_out(splits, values) -> Column:
    leaf = F.lit(0)
    for fi, t in splits:
        leaf = leaf * 2 + F.when(F.col(f"_b{fi}") > t, 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), leaf + 1)


def _best_split(rows, p, n_borders, lam):
    """Driver side, on at most leaves x p x bins sums: best shared (feature, border
    index) by Σ_leaves G_L²/(n_L+λ) + G_R²/(n_R+λ), by cumulative sums over the
    bins.  Of equal gains (up to 1e-12) the first feature and border wins."""
    best, best_gain = None, -math.inf
    cells = [[] for _ in range(p)]
    for r in rows:
        cells[int(r["_f"][2:])].append((r["_leaf"], r["_bin"], r["G"], r["n"]))
    for fi in range(p):
        if not cells[fi] or not n_borders[fi]:
            continue
        leaf, at, g, n = (np.array(v) for v in zip(*cells[fi]))
        leaf = np.unique(leaf, return_inverse=True)[1]
        sums = np.zeros((2, leaf.max() + 1, n_borders[fi] + 1))
        sums[0, leaf, at], sums[1, leaf, at] = g, n
        left = sums.cumsum(axis=2)
        right = left[:, :, -1:] - left
        gains = sum(np.where(n + lam > 0, g ** 2 / np.where(n + lam > 0, n + lam, 1.0), 0.0) for g, n in (left, right))
        for t, gain in enumerate(gains.sum(axis=0)[:-1].tolist()):
            if gain > best_gain + 1e-12:
                best, best_gain = (fi, t), gain
    return best


# ------------------------------------------------------------------- fitting
class Fitted:
    """A fitted model + its feature order; ``transform`` adds ``prediction``."""

    def __init__(self, name, params, model, features):
        self.name, self.params, self.model, self.features = name, params, model, list(features)

    def transform(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, (LinearExprModel, ObliviousBoostModel, TreesModel)):
            return self.model.transform(df)
        return self.model.transform(assemble(df, self.features)).drop(FEATURES)


def fit_model(name: str, params: dict, train: DataFrame, features, label: str) -> Fitted:
    """ML2-ML7: fit one model with one parameter cell."""
    features = list(features)
    if name == "SVR":
        return Fitted(name, params, fit_svr(train, features, label, params.get("C", 1.0),
                                            params.get("epsilon", 0.1),
                                            params.get("kernel", "linear")), features)
    if name in FITS:
        w, intercept = FITS[name](moments_by(train, features, label)[None], float(params["alpha"]))
        return Fitted(name, params, LinearExprModel(features, w, intercept), features)
    data = assemble(train, features)
    if name == "Random Forest":
        mf = params.get("max_features", "sqrt")
        est = RandomForestRegressor(
            featuresCol=FEATURES, labelCol=label, numTrees=int(params["n_estimators"]),
            maxDepth=30 if params.get("max_depth") is None else int(params["max_depth"]),
            minInstancesPerNode=max(1, math.ceil(int(params.get("min_samples_split", 2)) / 2)),
            featureSubsetStrategy=str(mf), seed=SEED)
    elif name == "XGBoost":
        cs = params.get("colsample_bytree", 1.0)
        est = GBTRegressor(featuresCol=FEATURES, labelCol=label,
                           maxIter=int(params["n_estimators"]), maxDepth=int(params["max_depth"]),
                           stepSize=float(params["learning_rate"]),
                           subsamplingRate=float(params.get("subsample", 1.0)),
                           featureSubsetStrategy="all" if cs >= 1.0 else str(cs), seed=SEED)
    elif name == "CatBoost":
        return Fitted(name, params, fit_oblivious(
            train, features, label, int(params["iterations"]), int(params["depth"]),
            float(params["learning_rate"]), float(params.get("l2_leaf_reg", 3.0))), features)
    else:
        raise KeyError(f"unknown model {name!r}")
    return Fitted(name, params, est.fit(data), features)


def rmse_of(fitted: Fitted, df: DataFrame, label: str) -> float:
    pr = fitted.transform(df)
    return pr.agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2))).first()[0]


# --------------------------------------------------------------- grid search
def cv_pairs(train: DataFrame, folds: DataFrame, n_folds: int, kind: str):
    """Yield (fold, train part, test part) from a fold-labelled frame:
    ``kind='kfold'`` (column fold per row) or ``'timeseries'`` (exploded
    (fold, role) rows as produced by :func:`splits.timeseries_cv`)."""
    for f in range(n_folds):
        if kind == "kfold":
            yield f, folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)
        else:
            part = folds.filter(F.col("fold") == f)
            yield f, part.filter("role = 'train'"), part.filter("role = 'test'")


def grid_search(name: str, grid: dict, train: DataFrame, folds: DataFrame, features, label: str,
                n_folds: int = 5, kind: str = "kfold", parallelism: int = 8):
    """ML9: exhaustive grid, mean held-out RMSE per cell, refit of the best
    cell on all ``train`` rows, wall time of the search + refit.
    Returns (Fitted, scores DataFrame (Model, params, fold, rmse),
    best cv rmse, seconds)."""
    from concurrent.futures import ThreadPoolExecutor
    t0 = time.time()
    cells = grid_cells(grid)
    if len(cells) > 1 and name not in FITS and (rows := _held(folds, list(features), label, kind)) is not None:
        return _dealt_grid(name, cells, train.sparkSession, rows, list(features), n_folds, kind, t0)
    if name == "SVR":
        return _svr_grid(cells, train.sparkSession, folds, list(features), label, n_folds, kind, t0)
    if name in FITS:
        return _linear_grid(name, cells, train.sparkSession, folds, list(features), label, n_folds, kind, t0)
    folds = folds.cache()
    jobs = [(ci, f, tr, te) for ci in range(len(cells)) for f, tr, te in
            cv_pairs(train, folds, n_folds, kind)]

    def run(job):
        ci, f, tr, te = job
        m = fit_model(name, cells[ci], tr, features, label)
        return ci, f, rmse_of(m, te, label)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        res = list(ex.map(run, jobs))
    folds.unpersist()
    mean = {}
    for ci, _, r in res:
        mean.setdefault(ci, []).append(r)
    best_ci = min(mean, key=lambda c: (float(np.mean(mean[c])), c))
    fitted = fit_model(name, cells[best_ci], train, features, label)
    secs = time.time() - t0
    spark = train.sparkSession
    scores = spark.createDataFrame(
        [(name, json.dumps(cells[ci], sort_keys=True), int(f), float(r)) for ci, f, r in res],
        "Model string, params string, fold int, rmse double")
    return fitted, scores, float(np.mean(mean[best_ci])), secs


def _linear_grid(name: str, cells: list, spark, folds: DataFrame, features: list, label: str, n_folds: int, kind: str, t0: float):
    """:func:`grid_search` of Ridge or Lasso: one pass over the rows for all cells and folds."""
    pairs, whole = fold_moments(folds, features, label, n_folds, kind)
    rows = []
    for params in cells:
        for f, (tr, te) in enumerate(pairs):
            w, b = FITS[name](tr, float(params["alpha"]))
            rows.append((name, json.dumps(params, sort_keys=True), f, math.sqrt(te.squared_error(w, b) / te.n)))
    mean = [float(np.mean([r[3] for r in rows[i * len(pairs):(i + 1) * len(pairs)]])) for i in range(len(cells))]
    best = int(np.argmin(mean))
    w, b = FITS[name](whole, float(cells[best]["alpha"]))
    fitted = Fitted(name, cells[best], LinearExprModel(features, w, b), features)
    scores = spark.createDataFrame(rows, "Model string, params string, fold int, rmse double")
    return fitted, scores, mean[best], time.time() - t0


def _held(folds: DataFrame, features: list, label: str, kind: str):
    """The rows of ``folds``, each once, if they are few enough to go to every task; their parts as in :func:`_svr_grid`."""
    if kind == "kfold":
        return dealt.held(folds, features, label, F.col("fold"))
    part = F.when(F.col("role") == "test", F.col("fold")).otherwise(-1)
    return dealt.held(folds.filter("role = 'test' OR fold = 0"), features, label, part)


def _dealt_grid(name: str, cells: list, spark, rows, features: list, n_folds: int, kind: str, t0: float):
    """:func:`grid_search` of a panel that goes to every task (:mod:`panelforge.operators.dealt`)."""
    trains_on = (lambda part, f: part != f) if kind == "kfold" else (lambda part, f: part < f)
    rmse = dealt.scores(spark, name, cells, rows, n_folds, trains_on, SEED)
    mean = [float(np.mean(r)) for r in rmse]
    best = int(np.argmin(mean))
    made = dealt.refit(spark, name, cells[best], rows, SEED)
    if name == "SVR":
        model = LinearExprModel(features, made.w, made.b, made.rff)
    elif name == "CatBoost":
        model = ObliviousBoostModel(features, made.base, [([(features[f], made.borders[f][t]) for f, t in splits], values)
                                                          for splits, values in made.trees])
    else:
        model = TreesModel(features, made)
    scores = spark.createDataFrame([(name, json.dumps(c, sort_keys=True), f, r) for c, of in zip(cells, rmse) for f, r in enumerate(of)],
                                   "Model string, params string, fold int, rmse double")
    return Fitted(name, cells[best], model, features), scores, mean[best], time.time() - t0


def _svr_grid(cells: list, spark, folds: DataFrame, features: list, label: str, n_folds: int, kind: str, t0: float):
    """:func:`grid_search` of SVR: the fits of all cells and folds share their passes over the rows,
    and so does the refit if there is but one cell."""
    if kind == "kfold":
        part, trains_on = F.col("fold"), [lambda part, f=f: part != f for f in range(n_folds)]
    else:  # each row once: the first stretch, and the tests of each fold
        folds = folds.filter("role = 'test' OR fold = 0")
        part = F.when(F.col("role") == "test", F.col("fold")).otherwise(-1)
        trains_on = [lambda part, f=f: part < f for f in range(n_folds)]
    held_out = [lambda part, f=f: part == f for f in range(n_folds)]
    given = [(float(c.get("C", 1.0)), float(c.get("epsilon", 0.1)), c.get("kernel", "linear")) for c in cells]
    jobs = [(ci, f) for ci in range(len(cells)) for f in range(n_folds)]
    whole = [svr.Fit(lambda part: part >= -1, *g) for g in given]
    limits = dict(n_components=100, max_iter=500, tol=1e-3, seed=SEED)
    with svr.Rows(folds, features, label, part) as rows:
        fits = [svr.Fit(trains_on[f], *given[ci]) for ci, f in jobs]
        lines = rows.fit(fits + (whole if len(cells) == 1 else []), **limits)
        rmse = rows.rmse(lines[:len(jobs)], [held_out[f] for _, f in jobs])
        mean = [float(np.mean(rmse[i * n_folds:(i + 1) * n_folds])) for i in range(len(cells))]
        best = int(np.argmin(mean))
        line = lines[-1] if len(cells) == 1 else rows.fit([whole[best]], **limits)[0]
    fitted = Fitted("SVR", cells[best], LinearExprModel(features, line.w, line.b, line.rff), features)
    scores = spark.createDataFrame([("SVR", json.dumps(cells[ci], sort_keys=True), f, r) for (ci, f), r in zip(jobs, rmse)],
                                   "Model string, params string, fold int, rmse double")
    return fitted, scores, mean[best], time.time() - t0


def predictions(fitted: Fitted, df: DataFrame, label: str, keep, split: str) -> DataFrame:
    """Long predictions rows (Model, Split, keep..., actual, predicted)."""
    return fitted.transform(df).select(F.lit(fitted.name).alias("Model"), F.lit(split).alias("Split"),
                                       *keep, F.col(label).alias("actual"),
                                       F.col("prediction").alias("predicted"))


def score_batch(df: DataFrame, fitted: "Fitted", scaler: dict | None = None,
                out: str = "Predicted") -> DataFrame:
    """ML11: validate that every fitted feature is present (the error lists
    the missing ones), scale with the fitted scaler, predict, append
    ``out``.  All input columns (ids, a target or not) pass through
    unchanged; the model reads scaled copies in the fitted feature order.
    Row-wise and narrow: no shuffle, works unchanged on a stream."""
    from panelforge.operators.relational import require_columns
    require_columns(df, fitted.features)
    orig = [F.col(c).alias(f"__o_{i}") for i, c in enumerate(df.columns)]
    feats = []
    for c in fitted.features:
        e = F.col(c).cast("double")
        if scaler:
            m, s = scaler[c]
            e = (e - F.lit(m)) / F.lit(s)
        feats.append(e.alias(c))
    pred = fitted.transform(df.select(*orig, *feats))
    return pred.select(*[F.col(f"__o_{i}").alias(c) for i, c in enumerate(df.columns)],
                       F.col("prediction").alias(out))


# ----------------------------------------------------------------- persistence
def save_fitted(fitted: Fitted, path: str) -> None:
    """SNK4: pyspark.ml models through MLWriter; SVR parameters, symmetric
    trees and trees fitted in tasks as Parquet tables."""
    spark = None
    if isinstance(fitted.model, ObliviousBoostModel):
        from pyspark.sql import SparkSession
        m = fitted.model
        rows = [(t, [f for f, _ in splits], [float(x) for _, x in splits], [float(v) for v in values])
                for t, (splits, values) in enumerate(m.trees)]
        SparkSession.getActiveSession().createDataFrame(
            [(-1, list(m.features), [], [m.base]), *rows],
            "tree int, features array<string>, thresholds array<double>, leaves array<double>"
        ).coalesce(1).write.mode("overwrite").parquet(path + "/trees")
    elif isinstance(fitted.model, LinearExprModel):
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        m = fitted.model
        rows = [("w", i, float(v)) for i, v in enumerate(m.w)] + [("b", 0, m.b)]
        if m.rff is not None:
            om, ph = m.rff
            rows += [("omega", i * om.shape[1] + j, float(om[i, j]))
                     for i in range(om.shape[0]) for j in range(om.shape[1])]
            rows += [("phase", i, float(v)) for i, v in enumerate(ph)]
        spark.createDataFrame(rows, "kind string, idx int, value double").coalesce(1) \
            .write.mode("overwrite").parquet(path + "/svr")
    elif isinstance(fitted.model, TreesModel):
        from pyspark.sql import SparkSession
        fitted.model.table(SparkSession.getActiveSession()).coalesce(1).write.mode("overwrite").parquet(path + "/nodes")
    else:
        fitted.model.write().overwrite().save(path + "/model")
    meta = json.dumps({"name": fitted.name, "params": fitted.params, "features": fitted.features,
                       "nodes": isinstance(fitted.model, TreesModel)})
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(path + "/meta")


def load_fitted(spark, path: str) -> Fitted:
    """SNK4: inverse of :func:`save_fitted`; a missing path raises."""
    meta = json.loads(spark.read.json(path + "/meta").first()["meta"])
    name, feats = meta["name"], meta["features"]
    if name in ("SVR", *FITS):
        rows = spark.read.parquet(path + "/svr").collect()
        get = lambda k: [r["value"] for r in sorted((r for r in rows if r["kind"] == k),
                                                     key=lambda r: r["idx"])]
        w, b = get("w"), get("b")[0]
        om, ph = get("omega"), get("phase")
        rff = (np.array(om).reshape(len(ph), len(feats)), np.array(ph)) if ph else None
        return Fitted(name, meta["params"], LinearExprModel(feats, w, b, rff), feats)
    if name == "CatBoost":
        rows = sorted(spark.read.parquet(path + "/trees").collect(), key=lambda r: r["tree"])
        trees = [(list(zip(r["features"], r["thresholds"])), list(r["leaves"])) for r in rows[1:]]
        model = ObliviousBoostModel(rows[0]["features"], rows[0]["leaves"][0], trees)
        return Fitted(name, meta["params"], model, feats)
    if meta.get("nodes"):
        return Fitted(name, meta["params"], TreesModel.from_table(feats, spark.read.parquet(path + "/nodes")), feats)
    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
    cls = {"Random Forest": RandomForestRegressionModel, "XGBoost": GBTRegressionModel}[name]
    return Fitted(name, meta["params"], cls.load(path + "/model"), feats)
