"""Registry of named queries: a Spark builder (spark, sf_dir) -> DataFrame
and, where SQL can express it, the equivalent DuckDB SQL over the same
tables.  ``__spark_entry__.py`` exposes both dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def rnd(df: DataFrame, dp: int = 6, keep=()) -> DataFrame:
    """Round every double column to ``dp`` places (hash-stable compare)."""
    return df.select(*[
        F.round(F.col(f.name), dp).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep
        else F.col(f.name)
        for f in df.schema.fields])


def R(inner: str, doubles: list, dp: int = 6) -> str:
    """SQL twin of :func:`rnd`: round the listed columns of ``inner``."""
    rep = ", ".join(f"round({c}, {dp}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) _r"
