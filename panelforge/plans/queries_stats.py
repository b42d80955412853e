"""Registered queries: aggregations and statistics (AGG1-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import metrics as met
from panelforge.operators import stats
from panelforge.plans import panels
from panelforge.plans.panels import P1_PREDICTORS, table
from panelforge.plans.registry import R, query, rnd
from panelforge.plans.sql_panels import P1_CTE, P3_CTE, SPLIT_CTE, with_

P3_SQL = ", " + P3_CTE.strip()

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("group_mean_profile", R(with_(P1_CTE) + "SELECT Code, " + ", ".join(
    f"avg({c}) AS {c}_mean" for c in P1_PREDICTORS) +
    ", avg(target) AS target_mean, regr_slope(target, Year) AS target_trend FROM p1 GROUP BY Code",
    [f"{c}_mean" for c in P1_PREDICTORS] + ["target_mean", "target_trend"]))
def q_group_mean_profile(spark, d):
    """AGG1 + AGG2 + JN7: per-entity means and OLS trend in one aggregate."""
    p = panels.nation_year_panel(spark, d)
    return rnd(stats.group_mean_profile(p, "Code", P1_PREDICTORS, "target", "Year"))


@query("group_ols_trend", R(with_(P1_CTE) + """
SELECT Code, regr_slope(target, Year) AS target_trend, count(target) AS n_known
FROM p1g GROUP BY Code""", ["target_trend"]))
def q_group_ols_trend(spark, d):
    """AGG2: per-entity slope of target ~ period, NULL targets skipped."""
    p = panels.nation_year_panel_gaps(spark, d)
    return rnd(p.groupBy("Code").agg(
        F.regr_slope(F.col("target"), F.col("Year").cast("double")).alias("target_trend"),
        F.count("target").alias("n_known")))


@query("group_median_rank", R(with_(P1_CTE) + """
SELECT Region, median(target) AS median,
       row_number() OVER (ORDER BY median(target) DESC, Region) AS rank
FROM p1 GROUP BY Region""", ["median"]))
def q_group_median_rank(spark, d):
    """AGG3 / CH3: exact median per group, ranked descending."""
    p = panels.nation_year_panel(spark, d)
    return rnd(stats.median_rank(p, "Region", "target"))


@query("boxplot_stats", R(with_(P1_CTE) + """
, q AS (SELECT Region, quantile_cont(target, 0.25) AS q1, median(target) AS median,
               quantile_cont(target, 0.75) AS q3 FROM p1 GROUP BY Region),
b AS (SELECT p1.Region, target, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM p1 JOIN q USING (Region) WHERE target IS NOT NULL)
SELECT q.Region, q.q1, q.median, q.q3, w.whisker_lo, w.whisker_hi, w.n_fliers FROM q LEFT JOIN (
  SELECT Region, min(target) FILTER (WHERE target >= lo AND target <= hi) AS whisker_lo,
         max(target) FILTER (WHERE target >= lo AND target <= hi) AS whisker_hi,
         count(*) FILTER (WHERE NOT (target >= lo AND target <= hi)) AS n_fliers
  FROM b GROUP BY Region) w USING (Region)""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"]))
def q_boxplot(spark, d):
    """AGG5 / CH3: box statistics per group (exact quartiles)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(stats.boxplot_stats(p, "Region", "target"))


def _iqr_sql(cols, dp=2):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS Feature, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS Outlier_count,
       round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count(*) * 100, {dp}) AS Outlier_pct,
       round(any_value(lo), {dp}) AS Lower_bound, round(any_value(hi), {dp}) AS Upper_bound
FROM lineitem, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem))""")
    return " UNION ALL ".join(parts)


@query("iqr_outliers", _iqr_sql(LI_COLS))
def q_iqr_outliers(spark, d):
    """AGG6: IQR outlier count / percent / bounds per column (whole
    lineitem; exact quartiles without a per-column value buffer)."""
    return stats.iqr_outliers(table(spark, d, "lineitem"), LI_COLS + ["not_a_column"])


@query("iqr_outlier_rows", R("""
SELECT o_orderkey, o_totalprice FROM orders,
  (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
     FROM orders))
WHERE o_totalprice < lo OR o_totalprice > hi""", ["o_totalprice"]))
def q_iqr_outlier_rows(spark, d):
    """AGG6b: rows flagged as outliers (whole orders table)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    f = stats.iqr_outlier_rows(o, ["o_totalprice"])
    return rnd(f.filter("o_totalprice_outlier").drop("o_totalprice_outlier"))


@query("skewness_table", with_(P1_CTE) + " UNION ALL ".join(
    f"SELECT '{c}' AS Feature, round(skewness({c}), 2) AS Skewness FROM p1" for c in P1_PREDICTORS))
def q_skewness(spark, d):
    """AGG7: adjusted Fisher-Pearson skewness per predictor, 2 dp, desc."""
    p = panels.nation_year_panel(spark, d)
    return stats.skewness_table(p, P1_PREDICTORS)


def _hist_sql(cols, bins=20):
    mm = " UNION ALL ".join(f"SELECT '{c}' AS Feature, min({c}) AS mn, max({c}) AS mx FROM lineitem"
                            for c in cols)
    v = " UNION ALL ".join(f"SELECT '{c}' AS Feature, CAST({c} AS DOUBLE) AS x FROM lineitem"
                           for c in cols)
    return R(f"""
WITH mm AS ({mm}), v AS ({v}),
b AS (SELECT v.Feature, CASE WHEN mx = mn THEN 0 ELSE CAST(least(floor((x - mn) / ((mx - mn) / {bins})), {bins - 1}) AS INTEGER) END AS bin
      FROM v JOIN mm USING (Feature) WHERE x IS NOT NULL),
g AS (SELECT Feature, mn, mx, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM mm)
SELECT g.Feature, g.bin, mn + g.bin * ((mx - mn) / {bins}) AS lower,
       mn + (g.bin + 1) * ((mx - mn) / {bins}) AS upper, coalesce(c.n, 0) AS count
FROM g LEFT JOIN (SELECT Feature, bin, count(*) AS n FROM b GROUP BY 1, 2) c USING (Feature, bin)""",
             ["lower", "upper"])


@query("histogram", _hist_sql(["l_quantity", "l_extendedprice"]))
def q_histogram(spark, d):
    """AGG8 / CH4: 20 equal-width bins, empty bins included."""
    return rnd(stats.histogram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 20))


@query("kde_curve", R("""
WITH st AS (SELECT count(l_quantity) AS n, stddev_samp(l_quantity) AS s, min(l_quantity) AS lo,
                   max(l_quantity) AS hi FROM lineitem),
p AS (SELECT n, s * pow(n, -0.2) AS h, lo, (hi - lo) / 199 AS step, (hi - lo) / 20 AS bw FROM st),
dv AS (SELECT l_quantity AS v, count(*) AS m FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS g)
SELECT g.g, any_value(lo + g.g * step) AS x,
       sum(m * exp(-0.5 * ((lo + g.g * step - v) / h) * ((lo + g.g * step - v) / h))) / any_value(n * h * sqrt(2 * pi())) AS density,
       sum(m * exp(-0.5 * ((lo + g.g * step - v) / h) * ((lo + g.g * step - v) / h))) / any_value(n * h * sqrt(2 * pi())) * any_value(n * bw) AS count_scaled
FROM g, p, dv GROUP BY g.g""", ["x", "density", "count_scaled"]))
def q_kde(spark, d):
    """AGG9 / CH4: Gaussian KDE (Scott) on a 200-point grid, whole column."""
    return rnd(stats.kde_curve(table(spark, d, "lineitem"), "l_quantity", 200, 20))


CORR_COLS = ["target", "Year", *P1_PREDICTORS]


def _corr_sql(cols):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    parts = []
    for a, b in pairs:
        parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM p1g")
        if a != b:
            parts.append(f"SELECT '{b}' AS f1, '{a}' AS f2, corr({a}, {b}) AS r FROM p1g")
    return R(with_(P1_CTE) + " UNION ALL ".join(parts), ["r"])


@query("corr_matrix", _corr_sql(CORR_COLS))
def q_corr(spark, d):
    """AGG10 / CH6: pairwise-complete Pearson matrix (long), one aggregate."""
    p = panels.nation_year_panel_gaps(spark, d)
    return rnd(stats.corr_matrix(p, CORR_COLS))


@query("vif_three", R(with_(P1_CTE) + """
, r AS (SELECT corr(qty_mean, price_mean) AS a, corr(qty_mean, discount_mean) AS b,
               corr(price_mean, discount_mean) AS c FROM p1),
v AS (SELECT 'qty_mean' AS Feature, 1 / (1 - (a*a + b*b - 2*a*b*c) / (1 - c*c)) AS VIF FROM r UNION ALL
      SELECT 'price_mean', 1 / (1 - (a*a + c*c - 2*a*b*c) / (1 - b*b)) FROM r UNION ALL
      SELECT 'discount_mean', 1 / (1 - (b*b + c*c - 2*a*b*c) / (1 - a*a)) FROM r)
SELECT Feature, VIF, CASE WHEN VIF > 10 THEN 'red' WHEN VIF > 5 THEN 'orange' ELSE 'green' END AS severity
FROM v""", ["VIF"]))
def q_vif_three(spark, d):
    """AGG11 + PRJ10 / CH7: VIF of three predictors (closed form on the SQL
    side; inverse correlation matrix here) and its severity bucket."""
    from panelforge.functions.exprs import severity_bucket
    p = panels.nation_year_panel(spark, d)
    v = stats.vif(p, ["qty_mean", "price_mean", "discount_mean"])
    return rnd(v.withColumn("severity", severity_bucket("VIF")))


@query("vif")
def q_vif(spark, d):
    """AGG11: VIF of every P1 predictor (k x k inverse on the driver)."""
    return rnd(stats.vif(panels.nation_year_panel(spark, d), P1_PREDICTORS))


@query("vif_drop_loop")
def q_vif_drop(spark, d):
    """AGG12: drop the highest-VIF predictor while VIF > 10 — one data pass,
    the loop runs on the cached covariance."""
    p = panels.nation_year_panel(spark, d)
    kept, dropped = stats.vif_drop_loop(p, P1_PREDICTORS, 10.0)
    rows = [(c, "kept", None) for c in kept] + [(c, "dropped", v) for c, v in dropped]
    return spark.createDataFrame(rows, "Feature string, status string, VIF double")


DESC_COLS = ["target", "acctbal_mean", "qty_mean", "n_orders"]


@query("describe", R(with_(P1_CTE) + " UNION ALL ".join(f"""
SELECT '{c}' AS Feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
       quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM p1""" for c in DESC_COLS),
                     ["mean", "std", "min", "q25", "q50", "q75", "max"]))
def q_describe(spark, d):
    """AGG13: describe() with exact quartiles, long."""
    return rnd(stats.describe(panels.nation_year_panel(spark, d), DESC_COLS))


@query("counts_distinct", with_(P1_CTE) + """
SELECT count(*) AS n_rows, count(DISTINCT Code) AS n_entities, count(DISTINCT Year) AS n_periods,
       min(Year) AS min_period, max(Year) AS max_period FROM p1""")
def q_counts(spark, d):
    """AGG14 + AGG27: row count, distinct entities / periods, period range."""
    p = panels.nation_year_panel(spark, d)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Code").alias("n_entities"),
                 F.count_distinct("Year").alias("n_periods"), F.min("Year").alias("min_period"),
                 F.max("Year").alias("max_period"))


METRIC_SQL = """count(*) AS N, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS RMSE,
       round(avg(abs(actual - predicted)), 4) AS MAE,
       round(CASE WHEN count(*) < 2 THEN NULL
                  WHEN var_pop(actual) = 0 THEN CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END, 4) AS R2"""


@query("regression_metrics", with_(P1_CTE, SPLIT_CTE) + f"""
SELECT Model, Split, {METRIC_SQL} FROM pred GROUP BY Model, Split""")
def q_regression_metrics(spark, d):
    """AGG15: N / RMSE / MAE / R² per (model, split), 4 dp."""
    return met.metrics_table(panels.pseudo_predictions(spark, d))


PERIODS = {"early": [2000], "late": [2001], "none": [1990]}


@query("metrics_by_period", with_(P1_CTE, SPLIT_CTE) + f"""
, pdim AS (SELECT * FROM (VALUES (0, 'early', 2000), (1, 'late', 2001), (2, 'none', 1990)) t(o, Period, Year)),
pv AS (SELECT * FROM pred WHERE Model = 'lag1' AND Split = 'Val')
SELECT Period, CAST(count(actual) AS INTEGER) AS N,
       round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS RMSE,
       round(avg(abs(actual - predicted)), 4) AS MAE,
       round(CASE WHEN count(actual) < 2 THEN NULL
                  WHEN var_pop(actual) = 0 THEN CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual)) END, 4) AS R2
FROM pdim LEFT JOIN pv USING (Year) GROUP BY o, Period""")
def q_metrics_by_period(spark, d):
    """AGG16: metrics per named period bucket (empty bucket: N=0, NULLs)."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'lag1' AND Split = 'Val'")
    return met.metrics_by_period(pr, PERIODS)


@query("error_by_period", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Year, avg(abs(actual - predicted)) AS MAE, count(*) AS N FROM pred WHERE Model = 'lag1'
GROUP BY Year""", ["MAE"]))
def q_error_by_period(spark, d):
    """AGG17 / CH12: MAE per period."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'lag1'")
    return rnd(met.error_by_period(pr))


@query("error_by_entity_topn", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Code, avg(abs(actual - predicted)) AS MAE FROM pred WHERE Model = 'train_mean'
GROUP BY Code ORDER BY MAE DESC, Code LIMIT 10""", ["MAE"]))
def q_error_topn(spark, d):
    """AGG18: the 10 entities with the largest MAE."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'train_mean'")
    return rnd(met.error_by_entity_topn(pr, "Code", top_n=10))


FITS_SQL = """
, fits AS (SELECT Code, count(target) FILTER (WHERE split = 'train') >= 3 AS converged
           FROM p1g LEFT JOIN ysplit USING (Year) GROUP BY Code)
"""


def _fits(spark, d):
    from panelforge.operators.splits import temporal_split
    g = temporal_split(panels.nation_year_panel_gaps(spark, d), "Year")
    return g.groupBy("Code").agg(
        (F.count(F.when(F.col("split") == "train", F.col("target"))) >= 3).alias("converged"))


@query("rmse_per_entity", with_(P1_CTE, SPLIT_CTE) + FITS_SQL + """
, r AS (SELECT Code, Split, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS RMSE
        FROM pred WHERE Model = 'lag1' AND Code IN (SELECT Code FROM fits WHERE converged)
        GROUP BY Code, Split),
grid AS (SELECT Code, converged, s.Split FROM fits, (VALUES ('Test'), ('Val')) s(Split))
SELECT grid.Code, grid.Split, r.RMSE, grid.converged FROM grid LEFT JOIN r USING (Code, Split)""")
def q_rmse_per_entity(spark, d):
    """AGG19: RMSE per (entity, split) + converged flag; failed entities
    appear with NULL RMSE."""
    pr = panels.pseudo_predictions(spark, d).filter("Model = 'lag1'")
    return met.rmse_per_entity(pr, _fits(spark, d), "Code")


@query("converged_count", with_(P1_CTE, SPLIT_CTE) + FITS_SQL + """
SELECT count(*) FILTER (WHERE converged) AS n_converged, count(*) AS n_entities FROM fits""")
def q_converged_count(spark, d):
    """AGG20: number of converged entity fits."""
    return met.converged_count(_fits(spark, d))


@query("contingency", with_(P1_CTE) + """
, ents AS (SELECT Code, row_number() OVER (ORDER BY md5(CAST(Code AS VARCHAR) || '|42'), Code) - 1 AS pos,
                  count(*) OVER () AS n FROM (SELECT DISTINCT Code FROM p1)),
lab AS (SELECT Code, CASE WHEN pos < floor(n * CAST(0.70 AS DOUBLE)) THEN 'train'
                          WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'test' ELSE 'val' END AS split FROM ents)
SELECT Region, split, count(*) AS n FROM (SELECT DISTINCT Code, Region FROM p1) JOIN lab USING (Code)
GROUP BY Region, split""")
def q_contingency(spark, d):
    """AGG22: counts per (group, label) — entity regions x split labels."""
    from panelforge.operators.splits import geographical_split
    ents = panels.nation_year_panel(spark, d).select("Code", "Region").distinct()
    return stats.contingency(geographical_split(ents, "Code"), "Region", "split")


@query("lag1_autocorr", R(with_(P1_CTE) + """
, l AS (SELECT target, lag(target) OVER (PARTITION BY Code ORDER BY Year) AS lg FROM p1)
SELECT corr(target, lg) AS lag1_autocorr, count(lg) AS n_pairs FROM l""", ["lag1_autocorr"]))
def q_lag1(spark, d):
    """AGG25: pooled lag-1 autocorrelation of the target."""
    return rnd(stats.lag1_autocorr(panels.nation_year_panel(spark, d), "Code", "Year", "target"))


@query("argmax_row", R(with_(P1_CTE) + """
SELECT Code, arg_max(Year, target) AS best_year, max(target) AS best_target FROM p1 GROUP BY Code""",
                       ["best_target"]))
def q_argmax(spark, d):
    """AGG26: period of the maximum per entity (max_by)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(p.groupBy("Code").agg(F.max_by("Year", "target").alias("best_year"),
                                     F.max("target").alias("best_target")))


@query("min_max_range", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Model, min(Year) AS min_year, max(Year) AS max_year,
       least(min(actual), min(predicted)) AS lo, greatest(max(actual), max(predicted)) AS hi
FROM pred GROUP BY Model""", ["lo", "hi"]))
def q_min_max(spark, d):
    """AGG27 / CH9: shared axis limits and period range per model."""
    pr = panels.pseudo_predictions(spark, d)
    return rnd(pr.groupBy("Model").agg(
        F.min("Year").alias("min_year"), F.max("Year").alias("max_year"),
        F.least(F.min("actual"), F.min("predicted")).alias("lo"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("hi")))


@query("first_match", with_(P1_CTE, SPLIT_CTE) + f"""
SELECT Model, Split, {METRIC_SQL} FROM pred WHERE Model = 'lag1' AND Split = 'Val' GROUP BY Model, Split""")
def q_first_match(spark, d):
    """FLT8: the (model, split) record, or an error listing what exists."""
    from panelforge.operators.relational import first_match
    m = met.metrics_table(panels.pseudo_predictions(spark, d))
    return first_match(m, Model="lag1", Split="Val")


@query("anti_join_missing", with_(P1_CTE, SPLIT_CTE) + FITS_SQL + """
SELECT DISTINCT Code FROM p1 WHERE Code NOT IN (SELECT Code FROM fits WHERE converged)""")
def q_anti_join(spark, d):
    """JN10: entities without a converged model (left anti join)."""
    fits = _fits(spark, d).filter("converged")
    return panels.nation_year_panel(spark, d).select("Code").distinct().join(fits, "Code", "left_anti")


@query("stack_long", R(with_(P1_CTE, SPLIT_CTE) + """
SELECT Code, Year, predicted, Model FROM pred""", ["predicted"]))
def q_stack_long(spark, d):
    """RSH2: several model outputs -> one long table with a tag column."""
    from panelforge.operators.reshape import stack_long
    pr = panels.pseudo_predictions(spark, d)
    frames = {m: pr.filter(F.col("Model") == m).select("Code", "Year", "predicted")
              for m in ("lag1", "train_mean")}
    return rnd(stack_long(frames, "Model"))


@query("panel_customer_quarter", R(with_(P1_CTE) + P3_SQL + "SELECT * FROM p3",
                                   ["target", "acctbal_mean", "urgent_share", "qty_mean", "discount_mean",
                                    "tax_mean", "price_mean"]))
def q_panel_p3(spark, d):
    """P3 builder at customer x quarter grain (scale fixture: one entity per
    customer)."""
    return rnd(panels.customer_quarter_panel(spark, d))


@query("customer_profile", R(with_(P1_CTE) + P3_SQL + """
SELECT Code, avg(n_orders) AS n_orders_mean, avg(qty_mean) AS qty_mean_mean, avg(target) AS target_mean,
       CASE WHEN count(target) >= 2 AND var_pop(Period) > 0 THEN regr_slope(target, Period) END AS target_trend
FROM p3 GROUP BY Code""", ["n_orders_mean", "qty_mean_mean", "target_mean", "target_trend"]))
def q_customer_profile(spark, d):
    """AGG1 + AGG2 at customer grain: per-entity means and trend for every
    customer (one grouped aggregate over the quarter panel)."""
    p = panels.customer_quarter_panel(spark, d)
    return rnd(stats.group_mean_profile(p, "Code", ["n_orders", "qty_mean"], "target", "Period"))
