"""Reshape operators (RSH1-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wide(df: DataFrame, keys: list, category: str, value: str,
               categories: list, check_duplicates: bool = True) -> DataFrame:
    """RSH1: long -> wide, one column per category value.

    One hash aggregate (map-side partial, one shuffle on ``keys``): each
    output column is ``first(value) FILTER (category = v)``.  A key that
    holds two rows for the same category raises at run time through
    ``raise_error`` inside the same aggregate, so the check costs no
    second pass.  ``categories`` must be given (a wide schema must not
    depend on data).
    """
    cat = F.col(category)
    aggs = []
    for v in categories:
        picked = F.first(F.when(cat == F.lit(v), F.col(value)), ignorenulls=True)
        if check_duplicates:
            dup = F.count_if(cat == F.lit(v)) > 1
            picked = F.when(dup, F.raise_error(F.lit(
                f"pivot_wide: duplicate key for category {v!r}"))).otherwise(picked)
        aggs.append(picked.alias(str(v)))
    return df.groupBy(*keys).agg(*aggs)


def unpivot_long(df: DataFrame, ids: list, values: list, name: str = "variable",
                 value: str = "value") -> DataFrame:
    """Inverse of :func:`pivot_wide` (narrow, no shuffle)."""
    return df.unpivot(ids, values, name, value)


def stack_long(frames: dict, tag: str, allow_missing: bool = False) -> DataFrame:
    """RSH2 / SET1: {tag value: frame} -> one long frame with a ``tag``
    column.  ``unionByName`` is a narrow concatenation (no shuffle)."""
    tagged = [f.withColumn(tag, F.lit(k)) for k, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tagged)


def dict_of_tables_to_long(tables: dict, tag_names: tuple, columns: list) -> DataFrame:
    """RSH3: {(tag1, tag2, ...): table} -> long table with the tag columns
    in front of a fixed column list."""
    parts = []
    for key, t in tables.items():
        key = key if isinstance(key, tuple) else (key,)
        cols = [F.lit(v).alias(n) for n, v in zip(tag_names, key)]
        parts.append(t.select(*cols, *columns))
    return reduce(lambda a, b: a.unionByName(b), parts)
