"""One modelling design end to end (ML10 ``_run_option`` semantics).

split -> (time sort for expanding CV) -> correlations on train -> robust
scaler fitted on train -> per model grid search on train folds -> refit ->
predictions for Test and Val.  Returns long predictions and a score table;
metrics are derived by aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import regress as rg
from panelforge.operators import scale as sc
from panelforge.operators import splits as spl
from panelforge.operators.metrics import metrics_table
from panelforge.session import cut_lineage, release_unreferenced


def _begun_anew(df: DataFrame) -> DataFrame:
    """``df`` with the same rows in the same partitions, computed once: the plans over it begin here.
    The driver keeps the plan of every job, and those of all families would each hold the panel's."""
    held = df.cache()
    out = cut_lineage(held)
    held.unpersist()
    return out


def run_option(panel: DataFrame, features, target: str, design: str = "temporal",
               models=("Ridge", "Lasso", "SVR", "Random Forest", "XGBoost", "CatBoost"),
               grids: dict | None = None, entity: str = "Code", period: str = "Year",
               n_folds: int = 5, seed: int = 42, parallelism: int = 4):
    """ML10.  ``design='geographical'``: entity split, contiguous K-fold on
    rows ordered (entity, period).  ``design='temporal'``: period split,
    expanding-window CV on rows ordered (period, entity).
    Returns (predictions DF, scores DF (Model, CV_RMSE, Time_s, params),
    metrics DF)."""
    grids = grids or rg.PARAM_GRIDS
    features = list(features)
    data = panel.filter(F.col(target).isNotNull())
    if design == "geographical":
        lab = spl.geographical_split(data, entity, seed)
        order, kind = [entity, period], "kfold"
    else:
        lab = spl.temporal_split(data, period)
        order, kind = [period, entity], "timeseries"
    params = sc.fit_robust_scaler(lab.filter("split = 'train'"), features)
    scaled = sc.apply_scaler(lab, params)
    if len(models) > 1:
        scaled = _begun_anew(scaled)
    scaled = scaled.cache()
    train = scaled.filter("split = 'train'")
    if kind == "kfold":
        folds = spl.kfold_contiguous(train, order, n_folds)
    else:
        folds = spl.timeseries_cv(train, order, n_folds)
    if len(models) > 1:
        folds = _begun_anew(folds)
    preds, scores = [], []
    spark = panel.sparkSession
    for name in models:
        fitted, _, cv, secs = rg.grid_search(name, grids[name], train, folds, features, target,
                                             n_folds, kind, parallelism)
        for split, tag in (("test", "Test"), ("val", "Val")):
            preds.append(rg.predictions(fitted, scaled.filter(F.col("split") == split), target,
                                        [entity, period], tag))
        scores.append((name, float(cv), float(secs), str(fitted.params)))
        release_unreferenced(spark)
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    # materialise the small outputs, then release the cached training frame
    pred = pred.cache()
    pred.count()
    scaled.unpersist()
    score_df = spark.createDataFrame(scores, "Model string, CV_RMSE double, Time_s double, params string")
    return pred, score_df, metrics_table(pred)
