"""Evaluation metrics over a long predictions table (AGG15-20, ML14).

Predictions are rows (model, split, entity, period, actual, predicted);
every metric is a grouped aggregate over them — never arrays held by the
driver, never row-order alignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.exprs import regression_metrics


def metrics_table(pred: DataFrame, by=("Model", "Split"), actual: str = "actual",
                  predicted: str = "predicted", dp: int | None = 4) -> DataFrame:
    """AGG15: N, RMSE, MAE, R² per group (R² NULL below two rows; 1/0
    rule for constant actuals)."""
    return pred.groupBy(*by).agg(*regression_metrics(actual, predicted, dp))


def metrics_by_period(pred: DataFrame, periods: dict, period: str = "Year",
                      actual: str = "actual", predicted: str = "predicted",
                      dp: int = 4) -> DataFrame:
    """AGG16: metrics per named period bucket {label: [periods]}; rows in
    no bucket are ignored; an empty bucket gives N=0 and NULL metrics.
    The bucket dimension is configuration (bounded), broadcast."""
    spark = pred.sparkSession
    dim_rows = [(i, lab, p) for i, (lab, ps) in enumerate(periods.items()) for p in ps]
    dim = spark.createDataFrame(dim_rows, f"_order int, Period string, {period} int")
    labels = spark.createDataFrame([(i, lab) for i, lab in enumerate(periods)], "_order int, Period string")
    # a row per configured period: predictions are joined in place, not shuffled by period
    found = (pred.join(F.broadcast(dim.drop("Period")), period)
             .groupBy("_order").agg(*regression_metrics(actual, predicted, dp)))
    return (labels.join(found, "_order", "left")
            .withColumn("N", F.coalesce(F.col("N"), F.lit(0)).cast("int"))
            .orderBy("_order").drop("_order"))


def error_by_period(pred: DataFrame, period: str = "Year", actual: str = "actual",
                    predicted: str = "predicted") -> DataFrame:
    """AGG17: MAE per period, in period order."""
    return (pred.groupBy(period)
            .agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("MAE"),
                 F.count(F.lit(1)).alias("N"))
            .orderBy(period))


def error_by_entity_topn(pred: DataFrame, entity: str = "Code", actual: str = "actual",
                         predicted: str = "predicted", top_n: int = 10) -> DataFrame:
    """AGG18: the ``top_n`` entities with the largest MAE (a top-k report:
    the limit is the feature)."""
    m = pred.groupBy(entity).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("MAE"))
    return m.orderBy(F.desc("MAE"), F.col(entity)).limit(top_n)


def rmse_per_entity(pred: DataFrame, fits: DataFrame, entity: str = "Code",
                    splits=("Test", "Val"), actual: str = "actual",
                    predicted: str = "predicted", dp: int = 4) -> DataFrame:
    """AGG19: per (entity, split) RMSE and the entity's ``converged`` flag.
    ``fits`` has (entity, converged); an entity whose fit failed gets one
    row per split with NULL RMSE (left join from the entity x split grid,
    built by exploding the configured split names — no cross join)."""
    grid = fits.select(entity, "converged",
                       F.explode(F.array(*[F.lit(s) for s in splits])).alias("Split"))
    ok = pred.join(fits.filter("converged").select(entity), entity, "left_semi")
    r = ok.groupBy(entity, "Split").agg(
        F.round(F.sqrt(F.avg((F.col(actual) - F.col(predicted)) ** 2)), dp).alias("RMSE"))
    return grid.join(r, [entity, "Split"], "left").select(entity, "Split", "RMSE", "converged")


def converged_count(fits: DataFrame) -> DataFrame:
    """AGG20: number of converged entity fits."""
    return fits.agg(F.count_if("converged").alias("n_converged"),
                    F.count(F.lit(1)).alias("n_entities"))


def results_table(metrics: DataFrame, scores: DataFrame, split: str) -> DataFrame:
    """ML14: Model, CV_RMSE, RMSE, MAE, R2, Time_s for one split, sorted by
    RMSE.  ``metrics`` from :func:`metrics_table`, ``scores`` has
    (Model, CV_RMSE, Time_s)."""
    return (metrics.filter(F.col("Split") == split)
            .join(scores, "Model", "left")
            .select("Model", "CV_RMSE", "RMSE", "MAE", "R2", "Time_s")
            .orderBy("RMSE", "Model"))
