"""Registered queries: regressors, grid search, option runs, batch scoring
(ML2-ML14, RPT5, RSH3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import metrics as met
from panelforge.operators import regress as rg
from panelforge.operators import reshape
from panelforge.operators import scale as sc
from panelforge.operators import splits as spl
from panelforge.operators.options import run_option
from panelforge.plans import panels
from panelforge.plans.panels import P1_PREDICTORS
from panelforge.plans.queries_cluster import _SCALE_SQL, SCALE_COLS
from panelforge.plans.registry import R, query, rnd
from panelforge.plans.sql_panels import P1_CTE, SPLIT_CTE, with_

FEATS = list(P1_PREDICTORS)


def _split_p1(spark, d):
    return spl.temporal_split(panels.nation_year_panel(spark, d), "Year")


# --------------------------------------------------- SQL-checkable variants
@query("ridge_one_feature", with_(P1_CTE, SPLIT_CTE) + """
, m AS (SELECT avg(qty_mean) AS mx, avg(target) AS my FROM ps WHERE split = 'train'),
c AS (SELECT sum((qty_mean - mx) * (target - my)) AS sxy, sum((qty_mean - mx) * (qty_mean - mx)) AS sxx
      FROM ps, m WHERE split = 'train'),
b AS (SELECT sxy / (sxx + 10) AS beta, my - sxy / (sxx + 10) * mx AS b0 FROM c, m)
SELECT Code, Year, round(b0 + beta * qty_mean, 2) AS predicted FROM ps, b""")
def q_ridge_1f(spark, d):
    """ML2 (closed form checkable): Ridge(alpha=10) on one predictor,
    fitted on train years, predicting every row."""
    p = _split_p1(spark, d)
    m = rg.fit_model("Ridge", {"alpha": 10}, p.filter("split = 'train'"), ["qty_mean"], "target")
    return m.transform(p).select("Code", "Year", F.round("prediction", 2).alias("predicted"))


@query("lasso_one_feature", with_(P1_CTE, SPLIT_CTE) + """
, m AS (SELECT avg(qty_mean) AS mx, avg(target) AS my, count(*) AS n FROM ps WHERE split = 'train'),
c AS (SELECT sum((qty_mean - mx) * (target - my)) / any_value(n) AS z,
             sum((qty_mean - mx) * (qty_mean - mx)) / any_value(n) AS v FROM ps, m WHERE split = 'train'),
b AS (SELECT sign(z) * greatest(abs(z) - 100, 0) / v AS beta FROM c),
b2 AS (SELECT beta, my - beta * mx AS b0 FROM b, m)
SELECT Code, Year, round(b0 + beta * qty_mean, 2) AS predicted FROM ps, b2""")
def q_lasso_1f(spark, d):
    """ML3 (soft-threshold checkable): Lasso(alpha=100) on one predictor."""
    p = _split_p1(spark, d)
    m = rg.fit_model("Lasso", {"alpha": 100, "max_iter": 5000}, p.filter("split = 'train'"),
                     ["qty_mean"], "target")
    return m.transform(p).select("Code", "Year", F.round("prediction", 2).alias("predicted"))


_ALPHAS = [0.01, 0.1, 1, 10, 100, 1000]


@query("grid_search_ridge_1f", with_(P1_CTE) + """
, r AS (SELECT qty_mean AS x, target AS y, row_number() OVER (ORDER BY Code, Year) - 1 AS pos,
               count(*) OVER () AS n FROM p1),
f AS (SELECT x, y, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
                             ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r),
a AS (SELECT CAST(alpha AS DOUBLE) AS alpha, params FROM (VALUES """ + ", ".join(
    f"({a}, '{{\"alpha\": {a}}}')" for a in _ALPHAS) + """) t(alpha, params)),
k AS (SELECT DISTINCT fold FROM f),
mu AS (SELECT k.fold, avg(f.x) AS mx, avg(f.y) AS my FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold),
mo AS (SELECT mu.fold, any_value(mx) AS mx, any_value(my) AS my, sum((f.x - mx) * (f.y - my)) AS sxy,
              sum((f.x - mx) * (f.x - mx)) AS sxx FROM mu JOIN f ON f.fold <> mu.fold GROUP BY mu.fold),
fit AS (SELECT a.params, mo.fold, sxy / (sxx + a.alpha) AS beta, my - sxy / (sxx + a.alpha) * mx AS b0
        FROM a, mo)
SELECT 'Ridge' AS Model, fit.params, fit.fold, round(sqrt(avg((f.y - b0 - beta * f.x) * (f.y - b0 - beta * f.x))), 4) AS rmse
FROM fit JOIN f ON f.fold = fit.fold GROUP BY fit.params, fit.fold""")
def q_grid_1f(spark, d):
    """ML9 (checkable): held-out RMSE of Ridge over the reference alpha grid
    and contiguous 5-fold CV, one predictor."""
    p = panels.nation_year_panel(spark, d)
    folds = spl.kfold_contiguous(p, ["Code", "Year"], 5)
    _, scores, _, _ = rg.grid_search("Ridge", {"alpha": _ALPHAS}, p, folds, ["qty_mean"], "target",
                                     5, "kfold")
    return rnd(scores, 4)


@query("grid_search_ridge_2f", with_(P1_CTE) + """
, r AS (SELECT qty_mean AS x1, price_mean AS x2, target AS y, row_number() OVER (ORDER BY Year, Code) - 1 AS pos, count(*) OVER () AS n FROM p1),
s AS (SELECT *, n - 5 * (n // 6) AS start, n // 6 AS t FROM r),
u AS (SELECT fold, x1, x2, y, pos < start + fold * t AS train FROM s, range(5) k(fold) WHERE pos < start + (fold + 1) * t),
a AS (SELECT CAST(alpha AS DOUBLE) AS alpha, params FROM (VALUES """ + ", ".join(
    f"({a}, '{{\"alpha\": {a}}}')" for a in _ALPHAS) + """) t(alpha, params)),
mu AS (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM u WHERE train GROUP BY fold),
mo AS (SELECT fold, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum((x1 - m1) * (x1 - m1)) AS s11, sum((x1 - m1) * (x2 - m2)) AS s12,
              sum((x2 - m2) * (x2 - m2)) AS s22, sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y FROM u JOIN mu USING (fold) WHERE train GROUP BY fold),
d AS (SELECT *, (s11 + alpha) * (s22 + alpha) - s12 * s12 AS det FROM a, mo),
fit AS (SELECT params, fold, ((s22 + alpha) * s1y - s12 * s2y) / det AS w1, ((s11 + alpha) * s2y - s12 * s1y) / det AS w2, m1, m2, my FROM d)
SELECT 'Ridge' AS Model, params, CAST(fold AS INTEGER) AS fold,
       round(sqrt(avg(power(y - my - w1 * (x1 - m1) - w2 * (x2 - m2), 2))), 4) AS rmse
FROM fit JOIN u USING (fold) WHERE NOT train GROUP BY params, fold""")
def q_grid_2f(spark, d):
    """ML9 (checkable): held-out RMSE of Ridge over the reference alpha grid and
    the expanding design, two predictors."""
    p = panels.nation_year_panel(spark, d)
    folds = spl.timeseries_cv(p, ["Year", "Code"], 5)
    _, scores, _, _ = rg.grid_search("Ridge", {"alpha": _ALPHAS}, p, folds, ["qty_mean", "price_mean"], "target", 5, "timeseries")
    return rnd(scores, 4)


# Example scoring coefficients (intercept, then one per scaled feature).
FIXED_INTERCEPT = 150000.0
FIXED_COEF = [1000.0, -2000.0, 500.0, 3000.0]


@query("batch_score", R(_SCALE_SQL + "SELECT Code, Year, " + f"{FIXED_INTERCEPT} + " + " + ".join(
    f"{w} * {c}" for w, c in zip(FIXED_COEF, SCALE_COLS)) + " AS Predicted FROM scaled", ["Predicted"]))
def q_batch_score(spark, d):
    """ML11 (fixed coefficients): validate, scale with the train-fitted
    scaler, predict, append — row-wise, no shuffle."""
    p = _split_p1(spark, d)
    params = sc.fit_robust_scaler(p.filter("split = 'train'"), SCALE_COLS)
    model = rg.Fitted("fixed", {}, rg.LinearExprModel(SCALE_COLS, FIXED_COEF, FIXED_INTERCEPT), SCALE_COLS)
    out = rg.score_batch(p.select("Code", "Year", *SCALE_COLS), model, params)
    return rnd(out.select("Code", "Year", "Predicted"))


@query("results_table", R(with_(P1_CTE, SPLIT_CTE) + """
, tr AS (SELECT 'lag1' AS Model, _lag AS predicted, target AS actual FROM pl WHERE split = 'train' AND _lag IS NOT NULL
         UNION ALL SELECT 'train_mean', _tm, target FROM pl WHERE split = 'train'),
cv AS (SELECT Model, sqrt(avg((actual - predicted) * (actual - predicted))) AS CV_RMSE FROM tr GROUP BY Model),
mt AS (SELECT Model, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS RMSE,
              round(avg(abs(actual - predicted)), 4) AS MAE,
              round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 4) AS R2
       FROM pred WHERE Split = 'Test' GROUP BY Model)
SELECT Model, CV_RMSE, RMSE, MAE, R2, CAST(NULL AS DOUBLE) AS Time_s FROM mt LEFT JOIN cv USING (Model)""",
                           ["CV_RMSE"]))
def q_results_table(spark, d):
    """ML14: Model, CV_RMSE, RMSE, MAE, R2, Time_s for the Test split,
    sorted by RMSE (pseudo models; CV_RMSE = in-sample train RMSE)."""
    from panelforge.operators.timeorder import lag_by_halo
    pr = panels.pseudo_predictions(spark, d)
    p = _split_p1(spark, d).filter("split = 'train'")
    tr = lag_by_halo(p, "Code", "Year", "target", [1]).withColumnRenamed("target_lag1", "_lag")
    tm = tr.groupBy("Code").agg(F.avg("target").alias("_tm"))
    tr = tr.join(tm, "Code")
    cvr = (tr.select(F.lit("lag1").alias("Model"), F.col("_lag").alias("predicted"), F.col("target").alias("actual"))
           .filter(F.col("predicted").isNotNull())
           .unionByName(tr.select(F.lit("train_mean").alias("Model"), F.col("_tm").alias("predicted"),
                                  F.col("target").alias("actual"))))
    scores = (cvr.groupBy("Model").agg(F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)).alias("CV_RMSE"))
              .withColumn("Time_s", F.lit(None).cast("double")))
    return rnd(met.results_table(met.metrics_table(pr), scores, "Test"))


@query("model_comparison", with_(P1_CTE, SPLIT_CTE) + """
, mt AS (SELECT Model, Split, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS RMSE,
                round(avg(abs(actual - predicted)), 4) AS MAE FROM pred GROUP BY Model, Split)
SELECT 'A' AS Option, Split, Model, RMSE, MAE FROM mt WHERE Model = 'lag1'
UNION ALL SELECT 'B', Split, Model, RMSE, MAE FROM mt WHERE Model = 'train_mean'""")
def q_model_comparison(spark, d):
    """RSH3 / RPT5: {(option, split): metrics} -> one long table with the
    option and split tags and a fixed column list."""
    m = met.metrics_table(panels.pseudo_predictions(spark, d))
    tables = {(opt, split): m.filter((F.col("Model") == model) & (F.col("Split") == split))
              for opt, model in (("A", "lag1"), ("B", "train_mean")) for split in ("Test", "Val")}
    return reshape.dict_of_tables_to_long(tables, ("Option", "Split"), ["Model", "RMSE", "MAE"])


# -------------------------------------------------------------- R-class fits
def _one_model(spark, d, name, design="temporal"):
    p = panels.nation_year_panel(spark, d)
    _, scores, metrics = run_option(p, FEATS, "target", design, models=(name,), grids=rg.SMALL_GRIDS)
    return rnd(metrics.join(scores.select("Model", "CV_RMSE"), "Model"))


@query("ridge")
def q_ridge(spark, d):
    """ML2: Ridge, grid search (expanding CV), Test/Val metrics."""
    return _one_model(spark, d, "Ridge")


@query("lasso")
def q_lasso(spark, d):
    """ML3: Lasso, grid search, Test/Val metrics."""
    return _one_model(spark, d, "Lasso")


@query("svr")
def q_svr(spark, d):
    """ML4: ε-insensitive linear SVR (distributed gradient steps)."""
    return _one_model(spark, d, "SVR")


@query("random_forest")
def q_rf(spark, d):
    """ML5: RandomForestRegressor."""
    return _one_model(spark, d, "Random Forest")


@query("gbt_level")
def q_gbt_level(spark, d):
    """ML6: gradient-boosted trees in the XGBoost role."""
    return _one_model(spark, d, "XGBoost")


@query("gbt_oblivious")
def q_gbt_oblivious(spark, d):
    """ML7: gradient-boosted trees in the CatBoost role (depth-limited)."""
    return _one_model(spark, d, "CatBoost")


@query("grid_search")
def q_grid_search(spark, d):
    """ML9 + ML13: full reference Ridge and Lasso grids, entity split with
    contiguous 5-fold CV; mean CV RMSE per cell and the best cell."""
    p = panels.nation_year_panel(spark, d)
    lab = spl.geographical_split(p, "Code")
    params = sc.fit_robust_scaler(lab.filter("split = 'train'"), FEATS)
    train = sc.apply_scaler(lab, params).filter("split = 'train'")
    folds = spl.kfold_contiguous(train, ["Code", "Year"], 5)
    out = None
    for name in ("Ridge", "Lasso"):
        _, scores, _, _ = rg.grid_search(name, rg.PARAM_GRIDS[name], train, folds, FEATS, "target")
        s = scores.groupBy("Model", "params").agg(F.avg("rmse").alias("mean_cv_rmse"))
        out = s if out is None else out.unionByName(s)
    from pyspark.sql import Window as W
    best = F.row_number().over(W.partitionBy("Model").orderBy("mean_cv_rmse", "params")) == 1
    return rnd(out.withColumn("is_best", best))


@query("option_run")
def q_option_run(spark, d):
    """ML10: the entity-split design with all six model families, each over
    its whole reference grid; metrics per (model, split) with CV RMSE."""
    p = panels.nation_year_panel(spark, d)
    _, scores, metrics = run_option(p, FEATS, "target", "geographical", grids=rg.PARAM_GRIDS)
    return rnd(metrics.join(scores.select("Model", "CV_RMSE"), "Model"))


@query("batch_score_model")
def q_batch_score_model(spark, d):
    """ML11 + SNK4: fit Ridge on train, save model and scaler to the shared
    checkpoint folder, load both back, score the later periods."""
    from panelforge.session import scratch_path
    p = _split_p1(spark, d)
    train = p.filter("split = 'train'")
    params = sc.fit_robust_scaler(train, FEATS)
    fitted = rg.fit_model("Ridge", {"alpha": 1}, sc.apply_scaler(train, params), FEATS, "target")
    base = scratch_path(spark, "artifacts")
    rg.save_fitted(fitted, base + "/ridge")
    sc.save_scaler(spark, params, base + "/scaler")
    model = rg.load_fitted(spark, base + "/ridge")
    scaler = sc.load_scaler(spark, base + "/scaler")
    new_rows = p.filter("split <> 'train'").select("Country", "Code", "Year", *FEATS)
    return rnd(rg.score_batch(new_rows, model, scaler).select("Code", "Year", "Predicted"))


@query("feature_ablation")
def q_ablation(spark, d):
    """ML12: Ridge with all predictors vs without two of them (by
    exclusion), Val metrics side by side."""
    from panelforge.operators.relational import predictor_list
    from panelforge.session import Panel
    p = _split_p1(spark, d)
    rows = None
    for tag, extra in (("all", []), ("ablated", ["n_orders", "tax_mean"])):
        feats = predictor_list(p.drop("split"), Panel(), extra)
        train = p.filter("split = 'train'")
        params = sc.fit_robust_scaler(train, feats)
        s = sc.apply_scaler(p, params)
        m = rg.fit_model("Ridge", {"alpha": 1}, s.filter("split = 'train'"), feats, "target")
        pr = rg.predictions(m, s.filter("split = 'val'"), "target", ["Code", "Year"], "Val")
        mt = met.metrics_table(pr).withColumn("variant", F.lit(tag))
        rows = mt if rows is None else rows.unionByName(mt)
    return rnd(rows)


@query("stream_score", R(_SCALE_SQL + "SELECT Code, Year, " + f"{FIXED_INTERCEPT} + " + " + ".join(
    f"{w} * {c}" for w, c in zip(FIXED_COEF, SCALE_COLS)) + " AS Predicted FROM scaled", ["Predicted"]))
def q_stream_score(spark, d):
    """ML11 on a stream: panel rows land as Parquet files (written by Spark
    from the tables), a readStream scores them with the train-fitted
    scaler and fixed coefficients, a checkpointed file sink collects the
    output; the result is read back."""
    from panelforge.session import scratch_path
    from panelforge.streaming.scoring import score_stream
    p = _split_p1(spark, d)
    params = sc.fit_robust_scaler(p.filter("split = 'train'"), SCALE_COLS)
    model = rg.Fitted("fixed", {}, rg.LinearExprModel(SCALE_COLS, FIXED_COEF, FIXED_INTERCEPT), SCALE_COLS)
    base = scratch_path(spark, "stream")
    rows = p.select("Code", "Year", *SCALE_COLS)
    rows.repartition(4, "Year").write.parquet(base + "/in")
    q = score_stream(spark, base + "/in", rows.schema, model, params, base + "/out", base + "/ckpt")
    q.awaitTermination()
    return rnd(spark.read.parquet(base + "/out").select("Code", "Year", "Predicted"))
