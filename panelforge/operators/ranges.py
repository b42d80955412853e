"""Range buckets by literal bounds.

A row's bucket is a pure expression of its sort key: bounds are taken from
a bounded random sample once and inlined as literals, so every exchange, count
and window that uses the bucket agrees on it, whatever the planner does.  The
bounds only balance the work; any bounds give right results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled sort keys per bucket, and the most buckets one expression searches.
SAMPLE_PER_BUCKET, MAX_BUCKETS = 40, 512


@dataclass(frozen=True)
class SortKey:
    """One part of a sort order; NULLs come first when ascending, last when descending."""
    column: str
    ascending: bool = True

    def order(self) -> Column:
        return F.col(self.column).asc_nulls_first() if self.ascending else F.col(self.column).desc_nulls_last()

    def before(self, bound) -> Column:
        """Does the row's value sort strictly before ``bound``?"""
        c = F.col(self.column)
        if bound is None:
            return F.lit(False) if self.ascending else c.isNotNull()
        return c.isNull() | (c < F.lit(bound)) if self.ascending else F.coalesce(c > F.lit(bound), F.lit(False))

    def equals(self, bound) -> Column:
        return F.col(self.column).eqNullSafe(F.lit(bound))


def sort_keys(by: Sequence[str | SortKey], ascending: bool | Sequence[bool] = True) -> list[SortKey]:
    flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    return [k if isinstance(k, SortKey) else SortKey(k, a) for k, a in zip(by, flags, strict=True)]


def _precedes(keys: Sequence[SortKey], bound: Sequence) -> Column:
    """Row sorts strictly before the bound, lexicographically over the keys."""
    out = F.lit(False)
    for key, value in reversed(list(zip(keys, bound))):
        out = key.before(value) | (key.equals(value) & out)
    return out


def bucket_count(n_rows: int, per_bucket: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(n_rows / per_bucket)))


def range_bucket(df: DataFrame, keys: Sequence[SortKey], n_buckets: int) -> Column:
    """Bucket number (0 ...) as an expression over the key columns; ascending in sort order."""
    n_buckets = min(n_buckets, MAX_BUCKETS)
    if n_buckets <= 1:
        return F.lit(0)
    names = [k.column for k in keys]
    sample = df.select(*names).withColumn("_draw", F.rand(42)).orderBy("_draw").limit(SAMPLE_PER_BUCKET * n_buckets)
    ordered = [tuple(r) for r in sample.orderBy(*[k.order() for k in keys]).select(*names).collect()]
    bounds: list[tuple] = []
    for i in range(1, n_buckets):
        at = i * len(ordered) // n_buckets
        if at < len(ordered) and (not bounds or bounds[-1] != ordered[at]):
            bounds.append(ordered[at])

    def search(low: int, high: int) -> Column:
        """Bounds low .. high - 1 are still undecided."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_precedes(keys, bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(bounds))


def row_positions(df: DataFrame, by: Sequence[str | SortKey], ascending: bool | Sequence[bool] = True, out: str = "position",
                  n_buckets: int | None = None, ties: Sequence[str] | None = None) -> DataFrame:
    """0-based position of every row in the given order, without ordering all
    rows in one task: a row number per bucket, after the rows of the buckets
    before.  Rows that tie on ``by`` are ordered by a hash of ``ties``
    (all columns unless given), which also splits hot tie groups."""
    spark = df.sparkSession
    keys = sort_keys(by, ascending)
    tie, bucket, start = f"_{out}_tie", f"_{out}_bucket", f"_{out}_start"
    whole = [c for c in (ties or df.columns) if not dict(df.dtypes)[c].startswith("map")]
    df = df.withColumn(tie, F.xxhash64(*whole) if whole else F.lit(0))
    keys = [*keys, SortKey(tie)]
    n_buckets = n_buckets or min(MAX_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn(bucket, range_bucket(df, keys, n_buckets))
    before = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket
    starts = df.groupBy(bucket).count().select(bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    rows = df.withColumn(out, F.row_number().over(Window.partitionBy(bucket).orderBy(*[k.order() for k in keys])))
    rows = rows.join(F.broadcast(starts), bucket)  # at most MAX_BUCKETS rows
    return rows.withColumn(out, (F.col(out) - 1 + F.col(start)).cast("long")).drop(tie, bucket, start)
