"""Registered queries: Shapley tables, report marts and chart-data frames
(ML31-35, AGG21, RPT1-2, RPT4, RPT9, CH1, CH4-6, CH8-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import explain as ex
from panelforge.operators import metrics as met
from panelforge.operators import regress as rg
from panelforge.operators import relational as rel
from panelforge.operators import scale as sc
from panelforge.operators import splits as spl
from panelforge.operators import stats
from panelforge.operators import timeorder as tw
from panelforge.plans import panels
from panelforge.plans.panels import P1_PREDICTORS
from panelforge.plans.queries_cluster import _SCALE_SQL, SCALE_COLS
from panelforge.plans.queries_models import FIXED_COEF
from panelforge.plans.registry import R, query, rnd
from panelforge.plans.sql_panels import P1_CTE, SPLIT_CTE, with_

COEF = dict(zip(SCALE_COLS, FIXED_COEF))


def _scaled(spark, d):
    p = spl.temporal_split(panels.nation_year_panel(spark, d), "Year")
    params = sc.fit_robust_scaler(p.filter("split = 'train'"), SCALE_COLS)
    s = sc.apply_scaler(p, params).withColumn("row_id", F.col("Code") * 10000 + F.col("Year"))
    return s


_PHI_SQL = _SCALE_SQL + ", mb AS (SELECT " + ", ".join(f"avg({c}) AS b_{c}" for c in SCALE_COLS) + \
    " FROM scaled WHERE split = 'train'), phi AS (" + " UNION ALL ".join(
        f"SELECT Code * 10000 + Year AS row_id, '{c}' AS Feature, {w} * ({c} - b_{c}) AS phi FROM scaled, mb"
        for c, w in COEF.items()) + ")\n"


@query("shap_linear", R(_PHI_SQL + "SELECT * FROM phi", ["phi"]))
def q_shap_linear(spark, d):
    """ML31: exact Shapley values of a linear model (fixed coefficients on
    the scaled predictors; background = train rows)."""
    s = _scaled(spark, d)
    return rnd(ex.shap_linear(s, "row_id", COEF, s.filter("split = 'train'")))


@query("mean_abs_importance", R(_PHI_SQL + """
SELECT Feature, avg(abs(phi)) AS Mean_Abs_SHAP FROM phi GROUP BY Feature""", ["Mean_Abs_SHAP"]))
def q_mean_abs(spark, d):
    """AGG21 / RPT4: mean |φ| per feature, sorted desc."""
    s = _scaled(spark, d)
    return rnd(ex.mean_abs_importance(ex.shap_linear(s, "row_id", COEF, s.filter("split = 'train'"))))


@query("shap_waterfall_table", R(_PHI_SQL + """
SELECT Feature, phi, 150000 + sum(phi) OVER (ORDER BY abs(phi) DESC, Feature
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
       row_number() OVER (ORDER BY abs(phi) DESC, Feature) AS step
FROM phi WHERE row_id = 72000""", ["phi", "running"]))
def q_waterfall(spark, d):
    """ML33: baseline + contributions of one row, by |φ| desc."""
    s = _scaled(spark, d)
    phi = ex.shap_linear(s, "row_id", COEF, s.filter("split = 'train'"))
    return rnd(ex.waterfall_table(phi, "row_id", 72000, 150000.0))


@query("shap_beeswarm_table", R(_PHI_SQL + """
, vals AS (""" + " UNION ALL ".join(
    f"SELECT Code * 10000 + Year AS row_id, '{c}' AS Feature, {c} AS value FROM scaled" for c in SCALE_COLS) + """),
rk AS (SELECT Feature, row_number() OVER (ORDER BY avg(abs(phi)) DESC, Feature) AS feature_rank FROM phi GROUP BY Feature)
SELECT phi.Feature, phi.row_id, phi.phi, vals.value, rk.feature_rank
FROM phi JOIN vals USING (row_id, Feature) JOIN rk USING (Feature)""", ["phi", "value"]))
def q_beeswarm(spark, d):
    """ML34: (feature, row, φ, feature value, importance rank)."""
    s = _scaled(spark, d)
    phi = ex.shap_linear(s, "row_id", COEF, s.filter("split = 'train'"))
    return rnd(ex.beeswarm_table(phi, s, "row_id", SCALE_COLS))


@query("shap_tree")
def q_shap_tree(spark, d):
    """ML32 + ML35: permutation Shapley values of a gradient-boosted model
    (one transform over all hybrid rows); the additivity gap per row is
    reported (Σφ = mean over samples of f(x) - f(z))."""
    s = _scaled(spark, d)
    train = s.filter("split = 'train'")
    fitted = rg.fit_model("XGBoost", {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1},
                          train, SCALE_COLS, "target")
    assert ex.is_tree_model(fitted.model)
    explain = s.filter("split <> 'train'")
    phi = ex.shap_permutation(fitted, explain, "row_id", train, SCALE_COLS, n_samples=50, n_background=100)
    return rnd(ex.mean_abs_importance(phi))


@query("shap_symmetric", R(with_(P1_CTE, SPLIT_CTE) + """
, t AS (SELECT avg(qty_mean) AS ta, avg(price_mean) AS tb FROM ps WHERE split = 'train'),
b AS (SELECT Code, Year, split, CAST(qty_mean > ta AS INT) AS a, CAST(price_mean > tb AS INT) AS b FROM ps, t),
g AS (SELECT a, b, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS w FROM b WHERE split = 'train' GROUP BY a, b),
v AS (SELECT x.Code, x.Year, x.a + 2 * x.b + 4 * x.a * x.b AS vab, sum(g.w * (x.a + 2 * g.b + 4 * x.a * g.b)) AS va,
             sum(g.w * (g.a + 2 * x.b + 4 * g.a * x.b)) AS vb, sum(g.w * (g.a + 2 * g.b + 4 * g.a * g.b)) AS v0
      FROM b AS x, g GROUP BY x.Code, x.Year, x.a, x.b)
SELECT Code, Year, 'qty_mean' AS Feature, (va - v0 + vab - vb) / 2 AS phi FROM v
UNION ALL SELECT Code, Year, 'price_mean', (vb - v0 + vab - va) / 2 FROM v""", ["phi"]))
def q_shap_symmetric(spark, d):
    """ML32 (SQL-checkable): exact Shapley values of a symmetric tree with an interaction,
    a + 2b + 4ab of two features above their train means, for all panel rows."""
    p = spl.temporal_split(panels.nation_year_panel(spark, d), "Year")
    train = p.filter("split = 'train'")
    t = train.agg(F.avg("qty_mean").alias("a"), F.avg("price_mean").alias("b")).first()
    tree = ([("qty_mean", t["a"]), ("price_mean", t["b"])], [0.0, 2.0, 1.0, 7.0])
    model = rg.ObliviousBoostModel(["qty_mean", "price_mean"], 0.0, [tree])
    keyed = p.withColumn("_key", F.struct("Code", "Year"))
    phi = ex.shap_symmetric(model, keyed, "_key", train)
    return rnd(phi.select("_key.Code", "_key.Year", "Feature", "phi"))


# ------------------------------------------------------------------ reports
@query("predictions_table", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Code, Country, Year, predicted AS Predicted_Rate, Model, Region FROM pred""", ["Predicted_Rate"]))
def q_predictions_table(spark, d):
    """RPT2 + RSH2: long predictions of several models with the region."""
    pr = panels.pseudo_predictions(spark, d)
    return rnd(pr.select("Code", "Country", "Year", F.col("predicted").alias("Predicted_Rate"),
                         "Model", "Region"))


@query("panel_table")
def q_panel_table(spark, d):
    """RPT1: ids, target, predictors + Cluster (k-means on entity profiles)
    + Region."""
    from panelforge.functions.exprs import cluster_label
    from panelforge.operators import cluster as cl
    from panelforge.plans.queries_cluster import _entity_profile
    prof, _ = _entity_profile(spark, d)
    km, _, _ = cl.kmeans_fit(prof, "_x", 4, seed=42, n_init=10, key="Code")
    p = panels.nation_year_panel(spark, d)
    lab = km.select("Code", cluster_label("cluster").alias("Cluster"))
    return rnd(p.join(lab, "Code", "left"))


@query("bi_bundle")
def q_bi_bundle(spark, d):
    """RPT9 + SNK3: write the report tables as one named bundle (Parquet
    per table) into the shared checkpoint folder; returns the manifest."""
    from panelforge.session import scratch_path
    from panelforge.sources.files import export_bundle
    pr = panels.pseudo_predictions(spark, d)
    tables = {
        "Panel": panels.nation_year_panel(spark, d),
        "Predictions": pr,
        "Model_Comparison": met.metrics_table(pr),
        "Trend_With_Predictions": tw.trend_with_connector(
            spl.temporal_split(panels.nation_year_panel(spark, d), "Year").filter("split = 'train'"),
            pr.select("Code", "Year", F.col("predicted").alias("target"), F.col("Model").alias("Series")),
            "Code", "Year", "target", "Series"),
    }
    paths = export_bundle(tables, scratch_path(spark, "bundle"))
    rows = [(n, spark.read.parquet(pth).count()) for n, pth in paths.items()]
    return spark.createDataFrame(rows, "table string, n_rows long")


# ------------------------------------------------------------------- charts
@query("chart_entity_trend", R(with_(P1_CTE) + "SELECT Year, target FROM p1 WHERE Code = 7", ["target"]))
def q_ch1(spark, d):
    """CH1: one entity's series in period order."""
    p = panels.nation_year_panel(spark, d)
    return rnd(p.filter(F.col("Code") == 7).select("Year", "target").orderBy("Year"))


def _hist_p1_sql(cols, bins=20):
    mm = " UNION ALL ".join(f"SELECT '{c}' AS Feature, min({c}) AS mn, max({c}) AS mx FROM p1" for c in cols)
    v = " UNION ALL ".join(f"SELECT '{c}' AS Feature, CAST({c} AS DOUBLE) AS x FROM p1" for c in cols)
    return R(with_(P1_CTE) + f"""
, mm AS ({mm}), v AS ({v}),
b AS (SELECT v.Feature, CASE WHEN mx = mn THEN 0 ELSE CAST(least(floor((x - mn) / ((mx - mn) / {bins})), {bins - 1}) AS INTEGER) END AS bin
      FROM v JOIN mm USING (Feature) WHERE x IS NOT NULL),
g AS (SELECT Feature, mn, mx, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM mm)
SELECT g.Feature, g.bin, mn + g.bin * ((mx - mn) / {bins}) AS lower,
       mn + (g.bin + 1) * ((mx - mn) / {bins}) AS upper, coalesce(c.n, 0) AS count
FROM g LEFT JOIN (SELECT Feature, bin, count(*) AS n FROM b GROUP BY 1, 2) c USING (Feature, bin)""",
             ["lower", "upper"])


@query("chart_hist", _hist_p1_sql(list(P1_PREDICTORS)))
def q_ch4(spark, d):
    """CH4: per-predictor histograms of the panel (20 bins)."""
    return rnd(stats.histogram(panels.nation_year_panel(spark, d), list(P1_PREDICTORS), 20))


@query("chart_strip", R(with_(P1_CTE) + """
, m AS (SELECT Region, row_number() OVER (ORDER BY median(target) DESC, Region) AS region_rank FROM p1 GROUP BY Region)
SELECT Region, Code, Year, target, region_rank FROM p1 JOIN m USING (Region)""", ["target"]))
def q_ch5(spark, d):
    """CH5: every point with its group's median rank (strip plot data)."""
    p = panels.nation_year_panel(spark, d)
    mr = stats.median_rank(p, "Region", "target").select("Region", F.col("rank").alias("region_rank"))
    return rnd(p.select("Region", "Code", "Year", "target").join(mr, "Region"))


CORR_SETS = {"socio": ["acctbal_mean", "urgent_share", "n_orders"],
             "health": ["qty_mean", "discount_mean", "tax_mean", "price_mean"]}


def _corr_sets_sql():
    parts = []
    sets = dict(CORR_SETS)
    sets["all_numeric"] = ["Code", "Year", "target", *P1_PREDICTORS]
    for name, cols in sets.items():
        for i, a in enumerate(cols):
            for b in cols[i:]:
                parts.append(f"SELECT '{name}' AS col_set, '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM ps WHERE split = 'train'")
                if a != b:
                    parts.append(f"SELECT '{name}', '{b}', '{a}', corr({a}, {b}) FROM ps WHERE split = 'train'")
    return R(with_(P1_CTE, SPLIT_CTE) + " UNION ALL ".join(parts), ["r"])


@query("chart_corr", _corr_sets_sql())
def q_ch6(spark, d):
    """CH6: three correlation matrices (two predictor blocks and every
    numeric column, period included) on train rows only."""
    p = spl.temporal_split(panels.nation_year_panel(spark, d), "Year").filter("split = 'train'")
    sets = dict(CORR_SETS)
    sets["all_numeric"] = [c for c in rel.numeric_columns(p.drop("split"))]
    out = None
    for name, cols in sets.items():
        m = stats.corr_matrix(p, cols).withColumn("col_set", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return rnd(out.select("col_set", "f1", "f2", "r"))


@query("chart_rmse", with_(P1_CTE, SPLIT_CTE) + """
, m AS (SELECT Model, Split, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS RMSE,
               round(avg(abs(actual - predicted)), 4) AS MAE FROM pred GROUP BY Model, Split)
SELECT t.Model, t.RMSE AS RMSE_test, t.MAE AS MAE_test, v.RMSE AS RMSE_val, v.MAE AS MAE_val
FROM (SELECT * FROM m WHERE Split = 'Test') t JOIN (SELECT * FROM m WHERE Split = 'Val') v USING (Model)""")
def q_ch8(spark, d):
    """CH8 + JN4: Test and Val metrics side by side, suffixed, on Model."""
    m = met.metrics_table(panels.pseudo_predictions(spark, d)).select("Model", "Split", "RMSE", "MAE")
    t = m.filter("Split = 'Test'").drop("Split")
    v = m.filter("Split = 'Val'").drop("Split")
    return rel.join_with_suffix(t, v, "Model")


@query("chart_actual_pred", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Code, Year, actual, predicted,
       least(min(actual) OVER (), min(predicted) OVER ()) AS axis_lo,
       greatest(max(actual) OVER (), max(predicted) OVER ()) AS axis_hi
FROM pred WHERE Model = 'lag1' AND Split = 'Val'""", ["actual", "predicted", "axis_lo", "axis_hi"]))
def q_ch9(spark, d):
    """CH9 + AGG27: (actual, predicted) points with shared axis limits
    (limits from one aggregate, attached as literals)."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'lag1' AND Split = 'Val'")
    lim = pr.agg(F.least(F.min("actual"), F.min("predicted")).alias("lo"),
                 F.greatest(F.max("actual"), F.max("predicted")).alias("hi")).first()
    return rnd(pr.select("Code", "Year", "actual", "predicted", F.lit(lim["lo"]).alias("axis_lo"),
                         F.lit(lim["hi"]).alias("axis_hi")))


@query("chart_resid_hist", R(with_(P1_CTE, SPLIT_CTE) + """
, r AS (SELECT actual - predicted AS x FROM pred WHERE Model = 'train_mean'),
mm AS (SELECT min(x) AS mn, max(x) AS mx FROM r),
b AS (SELECT CASE WHEN mx = mn THEN 0 ELSE CAST(least(floor((x - mn) / ((mx - mn) / 20)), 19) AS INTEGER) END AS bin FROM r, mm),
g AS (SELECT mn, mx, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM mm)
SELECT 'residual' AS Feature, g.bin, mn + g.bin * ((mx - mn) / 20) AS lower, mn + (g.bin + 1) * ((mx - mn) / 20) AS upper,
       coalesce(c.n, 0) AS count FROM g LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c USING (bin)""",
                              ["lower", "upper"]))
def q_ch10(spark, d):
    """CH10 + PRJ9 + AGG8: histogram of residuals."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'train_mean'")
    r = rel.residual_columns(pr, "actual", "predicted")
    return rnd(stats.histogram(r, ["residual"], 20))


@query("chart_resid_scatter", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Model, Code, Year, predicted, actual - predicted AS residual, abs(actual - predicted) AS abs_error FROM pred""",
                                ["predicted", "residual", "abs_error"]))
def q_ch11(spark, d):
    """CH11 + PRJ9: residual vs predicted points."""
    pr = panels.pseudo_predictions(spark, d)
    r = rel.residual_columns(pr, "actual", "predicted")
    return rnd(r.select("Model", "Code", "Year", "predicted", "residual", "abs_error"))


@query("chart_pred_trend", R(with_(P1_CTE, SPLIT_CTE) + """
, hist AS (SELECT Code, Year, target AS Rate, 'Actual' AS Series FROM ps WHERE split = 'train' AND Code = 3),
last AS (SELECT Code, max(Year) AS Year, arg_max(Rate, Year) AS Rate FROM hist GROUP BY Code)
SELECT * FROM hist
UNION ALL SELECT Code, Year, Rate, 'lag1' FROM last
UNION ALL SELECT Code, Year, predicted, Model FROM pred WHERE Code = 3 AND Model = 'lag1'""", ["Rate"]))
def q_ch13(spark, d):
    """CH13 + WIN4: one entity's history, connector and one model's forecast."""
    p = spl.temporal_split(panels.nation_year_panel(spark, d), "Year").filter("split = 'train' AND Code = 3")
    pr = panels.pseudo_predictions(spark, d).filter("Code = 3 AND Model = 'lag1'")
    fc = pr.select("Code", "Year", F.col("predicted").alias("target"), F.col("Model").alias("Series"))
    return rnd(tw.trend_with_connector(p, fc, "Code", "Year", "target", "Series"))


@query("chart_pred_rank", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Country, predicted FROM pred WHERE Model = 'lag1' AND Year = 2001
ORDER BY predicted DESC, Country LIMIT 10""", ["predicted"]))
def q_ch14(spark, d):
    """CH14 + ORD3: the top-10 predicted entities of one period."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'lag1' AND Year = 2001")
    return rnd(rel.top_n(pr, [F.desc("predicted"), "Country"], 10).select("Country", "predicted"))


@query("chart_pred_compare", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT a.Country, a.predicted AS pred_a, b.predicted AS pred_b, a.predicted - b.predicted AS diff
FROM (SELECT * FROM pred WHERE Model = 'lag1' AND Year = 2001) a
JOIN (SELECT * FROM pred WHERE Model = 'train_mean' AND Year = 2001) b USING (Country)""",
                               ["pred_a", "pred_b", "diff"]))
def q_ch15(spark, d):
    """CH15 + JN5: model A vs model B per entity for one period."""
    pr = panels.pseudo_predictions(spark, d).filter("Year = 2001")
    a = pr.filter("Model = 'lag1'").select("Country", F.col("predicted").alias("pred_a"))
    b = pr.filter("Model = 'train_mean'").select("Country", F.col("predicted").alias("pred_b"))
    return rnd(a.join(b, "Country", "inner").withColumn("diff", F.col("pred_a") - F.col("pred_b")))


@query("chart_region_compare", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT a.Region, a.m AS actual_mean, b.m AS predicted_mean FROM
  (SELECT Region, avg(actual) AS m FROM pred WHERE Model = 'lag1' AND Year = 2001 GROUP BY Region) a
JOIN (SELECT Region, avg(predicted) AS m FROM pred WHERE Model = 'lag1' AND Year = 2001 GROUP BY Region) b USING (Region)""",
                                 ["actual_mean", "predicted_mean"]))
def q_ch16(spark, d):
    """CH16 + JN6: group means of actual vs predicted, unmatched groups dropped."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'lag1' AND Year = 2001")
    a = pr.groupBy("Region").agg(F.avg("actual").alias("actual_mean"))
    b = pr.groupBy("Region").agg(F.avg("predicted").alias("predicted_mean"))
    return rnd(a.join(b, "Region", "inner"))


@query("chart_region_trend", R(with_(P1_CTE, SPLIT_CTE) + """
, hist AS (SELECT Region, Year, avg(target) AS Rate, 'Actual' AS Series FROM ps WHERE split = 'train' GROUP BY Region, Year),
last AS (SELECT Region, max(Year) AS Year, arg_max(Rate, Year) AS Rate FROM hist GROUP BY Region),
fc AS (SELECT Region, Year, avg(predicted) AS Rate, Model AS Series FROM pred GROUP BY Region, Year, Model),
models AS (SELECT DISTINCT Region, Series FROM fc)
SELECT * FROM hist UNION ALL SELECT last.Region, last.Year, last.Rate, models.Series FROM last JOIN models USING (Region)
UNION ALL SELECT Region, Year, Rate, Series FROM fc WHERE Region IN (SELECT Region FROM last)""", ["Rate"]))
def q_ch17(spark, d):
    """CH17: group-mean history + per-model group-mean forecasts with the
    connector row."""
    p = spl.temporal_split(panels.nation_year_panel(spark, d), "Year").filter("split = 'train'")
    hist = p.groupBy("Region", "Year").agg(F.avg("target").alias("target"))
    pr = panels.pseudo_predictions(spark, d)
    fc = pr.groupBy("Region", "Year", F.col("Model").alias("Series")).agg(F.avg("predicted").alias("target"))
    return rnd(tw.trend_with_connector(hist, fc, "Region", "Year", "target", "Series"))


@query("chart_r2", with_(P1_CTE, SPLIT_CTE) + """
, m AS (SELECT Model, Split,
               round(CASE WHEN count(*) < 2 THEN NULL
                          WHEN var_pop(actual) = 0 THEN CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
                          ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END, 4) AS R2
        FROM pred GROUP BY Model, Split)
SELECT t.Model, t.R2 AS R2_test, v.R2 AS R2_val
FROM (SELECT * FROM m WHERE Split = 'Test') t JOIN (SELECT * FROM m WHERE Split = 'Val') v USING (Model)""")
def q_ch8_r2(spark, d):
    """CH8 (R² panel) + JN4: Test and Val R² side by side on Model."""
    m = met.metrics_table(panels.pseudo_predictions(spark, d)).select("Model", "Split", "R2")
    t = m.filter("Split = 'Test'").drop("Split")
    v = m.filter("Split = 'Val'").drop("Split")
    return rel.join_with_suffix(t, v, "Model")
