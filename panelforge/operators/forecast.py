"""Per-entity time-series models (ML22-ML30, WIN9-10).

ARIMAX(p, 1, q) as regression with ARIMA errors (Δy_t = β·Δx_t + ARMA),
estimated by Hannan–Rissanen: (1) a long autoregression gives residual
estimates, (2) Δy on its own lags, the lagged residuals and Δx by least
squares.  Every step is a Spark job:

* all lags of all columns come from one halo exchange
  (:func:`panelforge.operators.timeorder.with_lags`); lags of Δy are differences of lags of y;
* least squares per entity = one grouped aggregate of the cross products
  (map-side partial sums, so a hot entity is split across tasks) and a
  k x k solve per entity on that single moments row (``applyInPandas``
  over one row per group);
* residuals and forecasts are linear recurrences, run as affine prefix scans
  over blocks of an entity's rows (:mod:`panelforge.operators.recurrence`).

Entities whose system is short or singular get ``converged = false`` and a
reason, and are excluded from pooled metrics (as upstream).  The trend
model (Prophet role) is a piecewise-linear trend with hinge changepoints
and an L2 penalty on slope changes, fitted the same way; its forecast is
a plain column expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.recurrence import final_state, linear_recurrence
from panelforge.operators.timeorder import row_position, with_lags
from panelforge.session import written

COEF_SCHEMA = "converged boolean, error string, coef array<double>, n long"


# ------------------------------------------------------------------ helpers
def with_position(df: DataFrame, entity: str, period: str) -> DataFrame:
    return row_position(df, entity, period).drop("_b")


def invertible(theta: np.ndarray) -> np.ndarray:
    """The MA coefficients with the same autocorrelations whose innovations can be
    recovered from the series: roots outside the unit circle are reflected into it."""
    roots = np.roots(np.append(1.0, theta))
    return np.real(np.poly(np.array([1 / np.conj(r) if abs(r) > 1 else r for r in roots])))[1:]


def _solve_rows(names, ridge: list | None = None, ma: slice | None = None):
    """applyInPandas body: one moments row per entity -> coefficients (those at
    ``ma`` made :func:`invertible`)."""
    k = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = int(r["_n"])
        key = {c: r[c] for c in pdf.columns if not c.startswith("_")}
        if n < k + 1:
            return pd.DataFrame([{**key, "converged": False, "error": f"only {n} rows for {k} terms",
                                  "coef": None, "n": n}])
        xtx = np.array([[r[f"_xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        xty = np.array([r[f"_xy_{i}"] for i in range(k)])
        if ridge is not None:
            xtx = xtx + np.diag(ridge)
        if np.linalg.matrix_rank(xtx) < k:
            return pd.DataFrame([{**key, "converged": False, "error": "singular system",
                                  "coef": None, "n": n}])
        beta = np.linalg.solve(xtx, xty)
        if not np.all(np.isfinite(beta)):
            return pd.DataFrame([{**key, "converged": False, "error": "non-finite", "coef": None, "n": n}])
        if ma is not None:
            beta[ma] = invertible(beta[ma])
        return pd.DataFrame([{**key, "converged": True, "error": None, "coef": beta.tolist(), "n": n}])
    return solve


def ols_by_entity(df: DataFrame, entity: str, y: str, xs, ridge: list | None = None, ma: slice | None = None) -> DataFrame:
    """Least squares of y on xs (no implicit intercept; pass a column of
    ones to get one) per entity: rows with a NULL term are skipped."""
    xs = list(xs)
    k = len(xs)
    # conditional sums (not a filter): an entity with no complete row still
    # gets its moments row (n = 0) and is reported as not converged
    ok = F.col(y).isNotNull()
    for c in xs:
        ok = ok & F.col(c).isNotNull()

    def s(e):
        return F.coalesce(F.sum(F.when(ok, e)), F.lit(0.0))

    aggs = [F.count_if(ok).alias("_n")]
    aggs += [s(F.col(xs[i]) * F.col(xs[j])).alias(f"_xx_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [s(F.col(xs[i]) * F.col(y)).alias(f"_xy_{i}") for i in range(k)]
    mom = df.groupBy(entity).agg(*aggs)
    etype = df.schema[entity].dataType.simpleString()
    return mom.groupBy(entity).applyInPandas(_solve_rows(xs, ridge, ma), f"{entity} {etype}, {COEF_SCHEMA}")


def _dot(coef: str, cols) -> F.Column:
    return sum((F.col(coef)[i] * F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(cols)),
               F.lit(0.0))


# ------------------------------------------------------------------- ARIMAX
def _numbers(cols) -> F.Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).cast("array<double>")


def _complete(cols) -> F.Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _difference(col: str, lag: int) -> F.Column:
    """Δ of ``col``, ``lag`` rows earlier."""
    return (F.col(f"{col}_lag{lag}") if lag else F.col(col)) - F.col(f"{col}_lag{lag + 1}")


def fit_arimax(train: DataFrame, entity: str, period: str, target: str, exog=(),
               order=(1, 1, 1), long_ar: int | None = None) -> DataFrame:
    """ML22: one row per entity with (converged, error, phi, theta, beta)
    and the state needed to forecast (last level, last p differences,
    last q innovations, last exog levels).  d must be 1.

    The innovations of the state are those of the fitted model, e_t = Δy_t - φ·Δy
    lags - θ·e lags - β·Δx over the rows whose differences are known, e = 0 before."""
    p, d, q = order
    if d != 1:
        raise ValueError("only d = 1 is supported (differenced regression with ARMA errors)")
    exog = list(exog)
    m = (long_ar or max(p + q, 2)) if q > 0 else 0
    depth = max(m, p)
    base = with_position(train.select(entity, period, target, *exog), entity, period)
    base = with_lags(base, entity, {target: range(1, depth + 2)} | {c: [1] for c in exog})
    ar_cols, dxs = [f"_dy_l{k}" for k in range(1, depth + 1)], [f"_dx_{i}" for i in range(len(exog))]
    frame = base.select(entity, "_rn", period, target, *exog, _difference(target, 0).alias("_dy"),
                        *[_difference(target, k).alias(c) for k, c in enumerate(ar_cols, 1)],
                        *[_difference(c, 0).alias(x) for c, x in zip(exog, dxs)])
    frame = written(frame, "arimax-rows")
    xs, known = ar_cols[:p] + dxs, frame
    if q > 0:
        long_xs = ar_cols[:m] + dxs
        first = ols_by_entity(frame, entity, "_dy", long_xs).select(F.col(entity).alias("_ce"), F.col("coef").alias("_c1"))
        known = frame.join(first, frame[entity].eqNullSafe(first["_ce"]), "left").drop("_ce")
        known = known.withColumn("_e", F.when(F.col("_c1").isNotNull() & _complete(["_dy", *long_xs]), F.col("_dy") - _dot("_c1", long_xs)))
        known = with_lags(known, entity, {"_e": range(1, q + 1)})
        xs = ar_cols[:p] + [f"_e_lag{k}" for k in range(1, q + 1)] + dxs
    if xs:
        coef = ols_by_entity(known, entity, "_dy", xs, ma=slice(p, p + q) if q else None)
    else:  # (0,1,0): random walk, nothing to estimate
        coef = frame.select(entity).distinct().select(
            entity, F.lit(True).alias("converged"), F.lit(None).cast("string").alias("error"),
            F.array().cast("array<double>").alias("coef"), F.lit(0).cast("long").alias("n"))

    def part(start: int, size: int) -> F.Column:
        return F.slice(F.coalesce("coef", F.array().cast("array<double>")), start, size) if size else F.array().cast("array<double>")

    coef = coef.withColumns({"phi": part(1, p), "theta": part(p + 1, q), "beta": part(p + q + 1, len(exog))}).drop("coef")
    last = frame.groupBy(F.col(entity).alias("_le")).agg(
        F.max_by(target, "_rn").alias("last_level"), F.max_by(period, "_rn").alias("last_period"),
        F.max_by(_numbers(["_dy", *ar_cols[:max(p, 1) - 1]]), "_rn").alias("last_dy"), F.max_by(_numbers(exog), "_rn").alias("last_exog"))
    model = coef.join(last, coef[entity].eqNullSafe(last["_le"])).drop("_le")
    none = F.array_repeat(F.lit(0.0), max(q, 1))
    if q > 0:
        model = written(model, "arimax-coefficients")
        fitted = model.filter("converged").select(F.col(entity).alias("_me"), "phi", "theta", "beta")
        rows = frame.join(fitted, frame[entity].eqNullSafe(fitted["_me"])).drop("_me")
        rows = rows.withColumns({"_x": F.col("_dy") - _dot("phi", ar_cols[:p]) - _dot("beta", dxs), "_a": F.transform("theta", lambda t: -t), "_0": none})
        ends = final_state(rows.filter(_complete(["_dy", *ar_cols[:p], *dxs])), entity, "_rn", "_x", "_a", "_0", "last_e").withColumnRenamed(entity, "_ee")
        model = model.join(ends, model[entity].eqNullSafe(ends["_ee"]), "left").drop("_ee").withColumn("last_e", F.coalesce("last_e", none))
    else:
        model = model.withColumn("last_e", none)
    model = model.withColumn("p", F.lit(p)).withColumn("q", F.lit(q))
    return written(model.select(entity, "converged", "error", "n", "phi", "theta", "beta", "last_level", "last_period",
                                "last_dy", "last_e", "last_exog", "p", "q"), "arimax-models")


def forecast_arimax(model: DataFrame, future: DataFrame, entity: str, period: str, exog=(),
                    out: str = "predicted", strict: bool = True) -> DataFrame:
    """ML23: forecasts for every future period of each entity (exog required for each).

    The level follows a recurrence of order p + 1, (1 - B)(1 - φB) y = x, where x is β·Δx
    and, for the first q steps, what the known innovations still
    add.  An entity that the model lacks raises ``KeyError`` (``strict=False``: it has no
    rows); entities whose model did not converge have no rows, as upstream."""
    exog = list(exog)
    if strict:
        known = model.select(F.col(entity).alias("_me"))
        missing = future.select(entity).distinct()
        missing = missing.join(known, missing[entity].eqNullSafe(known["_me"]), "left_anti")
        listed = [r[0] for r in missing.limit(20).collect()]
        if listed:
            raise KeyError(f"no fitted model for {missing.count()} entities, among them {listed}")
    shape = model.select("p", "q").first()
    p, q = (shape["p"], shape["q"]) if shape else (0, 0)
    rows = with_lags(with_position(future.select(entity, period, *exog), entity, period), entity, {c: [1] for c in exog})
    fitted = model.filter("converged").withColumnRenamed(entity, "_me")
    rows = rows.join(fitted, rows[entity].eqNullSafe(fitted["_me"]))
    h = F.col("_rn")
    x = F.lit(0.0)
    for i, c in enumerate(exog):
        before = F.when(h == 1, F.col("last_exog")[i]).otherwise(F.col(f"{c}_lag1"))
        x = x + F.col("beta")[i] * (F.col(c) - before)
    for j in range(q):  # θ_{j+1} meets the innovation h - 1 - j steps after the last one
        x = x + F.coalesce(F.when(h <= j + 1, F.col("theta")[j] * F.get("last_e", j + 1 - h.cast("int"))), F.lit(0.0))
    phi = [F.lit(-1.0), *[F.col("phi")[i] for i in range(p)], F.lit(0.0)]
    levels = [F.col("last_level").cast("double")]
    for i in range(p):
        levels.append(levels[-1] - F.col("last_dy")[i])
    rows = rows.select(entity, "_rn", period, x.alias("_x"), F.array(*[phi[i + 1] - phi[i] for i in range(p + 1)]).alias("_a"), F.array(*levels).alias("_l"))
    return written(linear_recurrence(rows, entity, "_rn", "_x", "_a", "_l", out, keep=[period]), "arimax-forecasts")


MODEL_FORMAT = 1


def save_forecast_models(model: DataFrame, path: str) -> None:
    """SNK4: the per-entity models of :func:`fit_arimax` (coefficients and end state,
    one row per entity) as a versioned Parquet table; an existing one is replaced."""
    model.withColumn("_format", F.lit(MODEL_FORMAT)).write.mode("overwrite").parquet(path)


def load_forecast_models(spark, path: str) -> DataFrame:
    """SNK4: inverse of :func:`save_forecast_models`; a missing path or another format raises."""
    model = spark.read.parquet(path)
    other = model.filter(F.col("_format") != MODEL_FORMAT).select("_format").first() if "_format" in model.columns else (None,)
    if other:
        raise ValueError(f"{path} holds forecast models of format {other[0]}, not {MODEL_FORMAT}")
    return model.drop("_format")


def periods_after(panel: DataFrame, entity: str, period: str, n: int) -> DataFrame:
    """(entity, period) of the ``n`` whole-number periods after each entity's last one."""
    kind = panel.schema[period].dataType
    last = panel.groupBy(entity).agg(F.max(period).alias("_last"))
    return last.select(entity, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i"), "_last").select(entity, (F.col("_last") + F.col("_i")).cast(kind).alias(period))


def evaluate_forecasts(model: DataFrame, fc: DataFrame, future: DataFrame, entity: str, period: str,
                       target: str, split_col: str = "Split", dp: int = 4):
    """ML24: pooled metrics per split over converged entities, and the
    per-entity table (entity, Split, RMSE, converged) with NULL RMSE for
    failed entities."""
    from panelforge.operators.metrics import metrics_table, rmse_per_entity
    pred = future.select(entity, period, split_col, F.col(target).alias("actual")) \
        .join(fc, [entity, period], "inner")
    pooled = metrics_table(pred, by=[split_col], dp=dp)
    splits = [r[0] for r in future.select(split_col).distinct().collect()]
    per = rmse_per_entity(pred.withColumnRenamed(split_col, "Split"),
                          model.select(entity, "converged"), entity, sorted(splits), dp=dp)
    return pooled, per


# --------------------------------------------------------------- trend model
def fit_trend(train: DataFrame, entity: str, period: str, target: str, exog=(),
              n_changepoints: int = 25, changepoint_range: float = 0.8,
              prior_scale: float = 0.05) -> DataFrame:
    """ML25: y = m + k·t + Σ δ_j (t - s_j)+ + β·x per entity, t = period
    rescaled to [0, 1] over the entity's history; changepoints s_j evenly
    placed in the first ``changepoint_range`` of the history (at most
    ``n_changepoints``, fewer for short series); δ shrunk by an L2 penalty
    (1/prior_scale²) — the MAP of a Gaussian prior on slope changes.  With
    n_changepoints = 0 this is per-entity OLS of y on t."""
    exog = list(exog)
    rng = train.groupBy(entity).agg(F.min(period).alias("_t0"), F.max(period).alias("_t1"),
                                    F.count(target).alias("_nn"),
                                    F.max(F.abs(target)).alias("_ys"))
    # y is scaled by its max |y| per entity (as the prior is stated on
    # that scale); coefficients are scaled back at forecast time.
    d = train.join(rng, entity).withColumn(
        "_t", (F.col(period) - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1)))
    d = d.withColumn("_y", F.try_divide(F.col(target), F.col("_ys")))
    ncp = n_changepoints
    cps = [changepoint_range * (j + 1) / (ncp + 1) for j in range(ncp)]
    hinge = [F.greatest(F.col("_t") - F.lit(s), F.lit(0.0)).alias(f"_h{j}") for j, s in enumerate(cps)]
    d = d.select("*", F.lit(1.0).alias("_one"), *hinge)
    xs = ["_one", "_t"] + [f"_h{j}" for j in range(ncp)] + exog
    pen = [0.0, 0.0] + [1.0 / prior_scale ** 2] * ncp + [0.0] * len(exog)
    coef = ols_by_entity(d, entity, "_y", xs, ridge=pen).cache()
    return coef.join(rng, entity, "left").withColumn("cps", F.array(*[F.lit(s) for s in cps])
                                                    if cps else F.array().cast("array<double>"))


def forecast_trend(model: DataFrame, future: DataFrame, entity: str, period: str, exog=(),
                   out: str = "predicted") -> DataFrame:
    """Forecast = the fitted trend extended (column expression, no UDF)."""
    exog = list(exog)
    j = future.select(entity, period, *exog).join(model.filter("converged"), entity, "inner")
    t = (F.col(period) - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1))
    ncp = model.select(F.size("cps")).first()
    ncp = ncp[0] if ncp else 0
    val = F.col("coef")[0] + F.col("coef")[1] * t
    for jj in range(ncp):
        val = val + F.col("coef")[2 + jj] * F.greatest(t - F.col("cps")[jj], F.lit(0.0))
    for i, c in enumerate(exog):
        val = val + F.col("coef")[2 + ncp + i] * F.col(c)
    return j.select(entity, period, (val * F.col("_ys")).alias(out))
