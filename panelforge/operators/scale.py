"""Robust scaling (ML1) fitted on the training rows only.

(x - median) / IQR with exact quartiles; an IQR of 0 divides by 1 (the
column is only centred).  ``ml.feature.RobustScaler`` is not used: its
quantiles are approximate and it zeroes a column whose IQR is 0.
Parameters are a small table (feature, center, scale) — persisted as
Parquet, applied as column expressions (codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.quantiles import quantile_row


def fit_robust_scaler(train: DataFrame, columns) -> dict:
    """{column: (center, scale)} from exact Q1 / median / Q3 of ``train``."""
    q = quantile_row(train, list(columns), [0.25, 0.5, 0.75])
    out = {}
    for c in columns:
        q1, med, q3 = q[c]
        iqr = None if q1 is None else q3 - q1
        out[c] = (med if med is not None else 0.0, iqr if iqr else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    """Replace (or add ``{c}{suffix}``) scaled columns."""
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items()})


def scaler_table(spark: SparkSession, params: dict) -> DataFrame:
    return spark.createDataFrame([(i, c, float(m), float(s)) for i, (c, (m, s)) in enumerate(params.items())],
                                 "position int, Feature string, center double, scale double")


def save_scaler(spark: SparkSession, params: dict, path: str) -> None:
    """SNK4: scaler parameters as a Parquet table (feature order kept)."""
    scaler_table(spark, params).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> dict:
    """SNK4: inverse of :func:`save_scaler`; a missing path raises."""
    rows = spark.read.parquet(path).orderBy("position").collect()
    return {r["Feature"]: (r["center"], r["scale"]) for r in rows}
