"""Registered queries: per-entity forecasting (ML22-ML30, RPT8) on the
nation-month panel (80 periods: 56 train / 12 test / 12 val)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import forecast as fc
from panelforge.operators import metrics as met
from panelforge.operators import splits as spl
from panelforge.operators import timeorder as tw
from panelforge.plans import panels
from panelforge.plans.registry import query, rnd
from panelforge.plans.sql_panels import P1_CTE, P4_CTE, with_
from panelforge.session import scratch_path

EXOG = ["n_orders", "urgent_share", "qty_mean"]


def _p4(spark, d):
    p = spl.temporal_split(panels.nation_month_panel(spark, d), "Period", out="part")
    split = F.when(F.col("part") == "test", "Test").when(F.col("part") == "val", "Val")
    return p.withColumn("Split", split).drop("part")


def _train_future(spark, d):
    p = _p4(spark, d)
    return p.filter(F.col("Split").isNull()), p.filter(F.col("Split").isNotNull())


_AR1_SQL = with_(P1_CTE, P4_CTE) + """
, tr AS (SELECT Code, Period, target, row_number() OVER (PARTITION BY Code ORDER BY Period) AS rn FROM p4s WHERE split = 'train'),
dd AS (SELECT a.Code, a.rn, a.target - b.target AS dy FROM tr a JOIN tr b ON a.Code = b.Code AND a.rn = b.rn + 1),
ll AS (SELECT a.Code, a.rn, a.dy, b.dy AS dy1 FROM dd a JOIN dd b ON a.Code = b.Code AND a.rn = b.rn + 1),
phi AS (SELECT Code, sum(dy * dy1) / sum(dy1 * dy1) AS phi, count(*) AS n FROM ll GROUP BY Code),
st AS (SELECT Code, arg_max(target, rn) AS lvl, max(rn) AS last FROM tr GROUP BY Code),
sd AS (SELECT dd.Code, dd.dy AS last_dy FROM dd JOIN st ON dd.Code = st.Code AND dd.rn = st.last),
fut AS (SELECT Code, Period, row_number() OVER (PARTITION BY Code ORDER BY Period) AS h FROM (__FUTURE__))
SELECT fut.Code, fut.Period,
       round(st.lvl + sd.last_dy * CASE WHEN phi.phi = 1 THEN fut.h ELSE phi.phi * (1 - power(phi.phi, fut.h)) / (1 - phi.phi) END, 2) AS predicted
FROM fut JOIN phi USING (Code) JOIN st USING (Code) JOIN sd USING (Code) WHERE phi.n >= 2"""


@query("ar1_diff_ls", _AR1_SQL.replace("__FUTURE__", "SELECT Code, Period FROM p4s WHERE split <> 'train'"))
def q_ar1(spark, d):
    """ML22/23 (closed form checkable): ARIMA(1,1,0) by least squares per
    entity, recursive forecast through every future period."""
    tr, fu = _train_future(spark, d)
    m = fc.fit_arimax(tr, "Code", "Period", "target", (), (1, 1, 0))
    f = fc.forecast_arimax(m, fu, "Code", "Period")
    return f.select("Code", "Period", F.round("predicted", 2).alias("predicted"))


HORIZON = 12


@query("forecast_beyond_labels", _AR1_SQL.replace("__FUTURE__", f"""SELECT Code, Period FROM p4s WHERE split <> 'train'
UNION ALL SELECT Code, last + i FROM (SELECT Code, max(Period) AS last FROM p4s GROUP BY Code), range(1, {HORIZON + 1}) k(i)"""))
def q_beyond(spark, d):
    """SNK4 + ML29: per-entity models saved, loaded back and run through the labelled
    periods and the year after the last of them."""
    tr, fu = _train_future(spark, d)
    path = scratch_path(spark, "forecast-models")
    fc.save_forecast_models(fc.fit_arimax(tr, "Code", "Period", "target", (), (1, 1, 0)), path)
    ahead = fu.select("Code", "Period").unionByName(fc.periods_after(_p4(spark, d), "Code", "Period", HORIZON))
    f = fc.forecast_arimax(fc.load_forecast_models(spark, path), ahead, "Code", "Period")
    return f.select("Code", "Period", F.round("predicted", 2).alias("predicted"))


@query("trend_zero_cp", with_(P1_CTE, P4_CTE) + """
, rg AS (SELECT Code, min(Period) AS t0, max(Period) AS t1 FROM p4s WHERE split = 'train' GROUP BY Code),
tr AS (SELECT p4s.Code, (Period - t0) / greatest(t1 - t0, 1) AS t, target FROM p4s JOIN rg USING (Code) WHERE split = 'train'),
co AS (SELECT Code, regr_slope(target, t) AS sl, regr_intercept(target, t) AS ic FROM tr GROUP BY Code)
SELECT p4s.Code, p4s.Period, round(ic + sl * (Period - t0) / greatest(t1 - t0, 1), 2) AS predicted
FROM p4s JOIN co USING (Code) JOIN rg USING (Code) WHERE split <> 'train'""")
def q_trend0(spark, d):
    """ML25 (checkable): trend model without changepoints = per-entity OLS
    line on rescaled time, extended over the future periods."""
    tr, fu = _train_future(spark, d)
    m = fc.fit_trend(tr, "Code", "Period", "target", (), n_changepoints=0)
    f = fc.forecast_trend(m, fu, "Code", "Period")
    return f.select("Code", "Period", F.round("predicted", 2).alias("predicted"))


@query("arimax_fit")
def q_arimax_fit(spark, d):
    """ML22: ARIMAX(1,1,1) + one exogenous regressor per entity (Hannan–
    Rissanen on distributed moments); failures flagged, not dropped."""
    tr, _ = _train_future(spark, d)
    m = fc.fit_arimax(tr, "Code", "Period", "target", ["n_orders"], (1, 1, 1))
    return rnd(m.select("Code", "converged", "error", "n", "phi", "theta", "beta"))


@query("arimax_forecast")
def q_arimax_forecast(spark, d):
    """ML23 + WIN9: walk-forward forecasts for every future period."""
    tr, fu = _train_future(spark, d)
    m = fc.fit_arimax(tr, "Code", "Period", "target", ["n_orders"], (1, 1, 1))
    f = fc.forecast_arimax(m, fu, "Code", "Period", ["n_orders"])
    return rnd(tw.horizon_index(f, "Code", "Period"))


@query("arimax_evaluate")
def q_arimax_eval(spark, d):
    """ML24 + AGG19/20: pooled Test/Val metrics over converged entities and
    the per-entity RMSE table."""
    tr, fu = _train_future(spark, d)
    m = fc.fit_arimax(tr, "Code", "Period", "target", [], (1, 1, 1))
    f = fc.forecast_arimax(m, fu, "Code", "Period")
    pooled, per = fc.evaluate_forecasts(m, f, fu, "Code", "Period", "target")
    conv = met.converged_count(m)
    return pooled.withColumn("n_converged", F.lit(conv.first()["n_converged"]))


@query("trend_model")
def q_trend(spark, d):
    """ML25: piecewise-linear trend (25 changepoints in the first 80 %,
    L2-shrunk slope changes) + one regressor; Test/Val metrics."""
    tr, fu = _train_future(spark, d)
    m = fc.fit_trend(tr, "Code", "Period", "target", ["n_orders"])
    f = fc.forecast_trend(m, fu, "Code", "Period", ["n_orders"])
    pooled, _ = fc.evaluate_forecasts(m, f, fu, "Code", "Period", "target")
    return pooled


ORDERS = [(1, 1, 0), (2, 1, 0), (1, 1, 1), (0, 1, 1), (2, 1, 1)]


def _sweep(spark, d, variants):
    tr, fu = _train_future(spark, d)
    out = None
    for tag, order, ex in variants:
        m = fc.fit_arimax(tr, "Code", "Period", "target", ex, order)
        f = fc.forecast_arimax(m, fu, "Code", "Period", ex)
        pooled, _ = fc.evaluate_forecasts(m, f, fu, "Code", "Period", "target")
        pooled = pooled.withColumn("variant", F.lit(tag))
        out = pooled if out is None else out.unionByName(pooled)
    return out


@query("order_sweep")
def q_order_sweep(spark, d):
    """ML26: pooled metrics for five (p,1,q) orders."""
    return _sweep(spark, d, [(str(o), o, []) for o in ORDERS])


@query("exog_sweep")
def q_exog_sweep(spark, d):
    """ML27: one exogenous candidate at a time, order (1,1,0)."""
    return _sweep(spark, d, [(c, (1, 1, 0), [c]) for c in EXOG])


@query("exog_count_sweep")
def q_exog_count(spark, d):
    """ML28: 1, 2, 3 exogenous regressors, order (1,1,0)."""
    return _sweep(spark, d, [(str(k), (1, 1, 0), EXOG[:k]) for k in (1, 2, 3)])


@query("future_forecast_table")
def q_future_table(spark, d):
    """ML29 + JN11: forecasts for the periods after the labelled ones,
    attached to the panel rows by (entity, period)."""
    tr, fu = _train_future(spark, d)
    m = fc.fit_arimax(tr, "Code", "Period", "target", [], (1, 1, 0))
    f = fc.forecast_arimax(m, fu, "Code", "Period")
    return rnd(fu.select("Code", "Period", "Split").join(f, ["Code", "Period"], "inner"))


@query("persistence_comparison")
def q_persistence(spark, d):
    """ML30 / RPT8: naive last-value baseline vs ARIMAX and trend models,
    univariate and +1 regressor; Test/Val RMSE and R² (naive: Val only)."""
    tr, fu = _train_future(spark, d)
    rows = []
    naive = tw.naive_persistence(tr, fu.filter("Split = 'Val'"), "Code", "Period", "target")
    nm = met.metrics_table(naive.withColumnRenamed("target", "actual"), by=["Split"])
    rows.append(nm.withColumns({"Model": F.lit("Naive"), "Variant": F.lit("last value")}))
    for name, variant, ex in (("ARIMAX", "univariate", []), ("ARIMAX", "+1 exog", ["n_orders"]),
                              ("Trend", "univariate", []), ("Trend", "+1 exog", ["n_orders"])):
        if name == "ARIMAX":
            m = fc.fit_arimax(tr, "Code", "Period", "target", ex, (1, 1, 1))
            f = fc.forecast_arimax(m, fu, "Code", "Period", ex)
        else:
            m = fc.fit_trend(tr, "Code", "Period", "target", ex)
            f = fc.forecast_trend(m, fu, "Code", "Period", ex)
        pooled, _ = fc.evaluate_forecasts(m, f, fu, "Code", "Period", "target")
        rows.append(pooled.withColumns({"Model": F.lit(name), "Variant": F.lit(variant)}))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("Model", "Variant", "Split", "N", "RMSE", "MAE", "R2")
