"""Train / test / validation splits and cross-validation folds (WIN5-8).

Every split is a ``split`` label column on the one input DataFrame
(filter lazily), never three copies.  Global orderings (entities by
hash, rows by time) use :func:`global_rank`, a distributed rank: buckets
by literal bounds, a row number per bucket, and offsets from a summary of
one row per bucket.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ranges import row_positions

# Split fractions (70 % train, next 15 % test, rest val).
TRAIN_FRAC = 0.70
TEST_END_FRAC = 0.85
# A table of at most so many periods is labelled by literals, a longer one by a join.
MAX_PERIODS = 10_000


def global_rank(df: DataFrame, order_cols, out: str = "_pos", partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order_cols``
    (ascending; rows that tie are put in a fixed order by a hash of the row)."""
    return row_positions(df, list(order_cols), out=out, n_buckets=partitions)


def _label(pos: Column, n: Column) -> Column:
    a = F.floor(n.cast("double") * F.lit(TRAIN_FRAC))
    b = F.floor(n.cast("double") * F.lit(TEST_END_FRAC))
    return F.when(pos < a, "train").when(pos < b, "test").otherwise("val")


def temporal_split(df: DataFrame, period: str = "Year", out: str = "split") -> DataFrame:
    """WIN5: distinct periods in order; the first floor(0.70 n) are
    train, up to floor(0.85 n) test, the rest val (22 -> 15/3/4)."""
    # the periods of a panel are few; collected once, they give rank and count
    # without reading the input again
    found = sorted(r[0] for r in df.select(period).distinct().filter(F.col(period).isNotNull()).limit(MAX_PERIODS + 1).collect())
    if len(found) <= MAX_PERIODS:
        n = len(found)
        a, b = math.floor(n * TRAIN_FRAC), math.floor(n * TEST_END_FRAC)
        if not n:
            return df.withColumn(out, F.lit(None).cast("string"))
        c = F.col(period)
        later = F.when(c < F.lit(found[b]), "test").otherwise("val") if b < n else F.lit("test")
        label = F.when(c < F.lit(found[a]), "train").otherwise(later)
        return df.withColumn(out, F.when(c.isNotNull(), label))
    periods = df.select(period).distinct().filter(F.col(period).isNotNull())
    ranked = global_rank(periods, [period])
    lab = ranked.withColumn(out, _label(F.col("_pos"), F.lit(ranked.count()))).select(period, out)
    return df.join(lab, period, "left")


def entity_hash(entity: str, seed: int) -> Column:
    """Portable shuffle key: md5 of the entity text and the seed."""
    return F.md5(F.concat(F.col(entity).cast("string"), F.lit(f"|{seed}")))


def geographical_split(df: DataFrame, entity: str = "Code", seed: int = 42,
                       order: str = "md5", entity_list=None, out: str = "split") -> DataFrame:
    """WIN6: whole entities to one split, 70/15/15 of the shuffled list.

    ``order='md5'``: entities ranked by md5(entity || '|' || seed) — a
    reproducible shuffle that any SQL engine can recompute.
    ``order='mt19937'``: the NumPy ``RandomState(seed).shuffle`` of the
    given ``entity_list`` (configuration, so it is shuffled on the driver)
    for exact parity with the original list-based split."""
    if order == "mt19937":
        if entity_list is None:
            raise ValueError("order='mt19937' needs the configured entity_list")
        lst = list(entity_list)
        np.random.RandomState(seed).shuffle(lst)
        n = len(lst)
        a, b = int(n * TRAIN_FRAC), int(n * TEST_END_FRAC)
        rows = [(e, "train" if i < a else "test" if i < b else "val") for i, e in enumerate(lst)]
        lab = df.sparkSession.createDataFrame(rows, [entity, out])
        return df.join(F.broadcast(lab), entity, "left")
    ents = df.select(entity).distinct().filter(F.col(entity).isNotNull())
    ents = ents.withColumn("_h", entity_hash(entity, seed))
    ranked = global_rank(ents, ["_h", entity])
    n = F.lit(ranked.count())
    lab = ranked.withColumn(out, _label(F.col("_pos"), n)).select(entity, out)
    return df.join(lab, entity, "left")


def kfold_contiguous(df: DataFrame, order_cols, k: int = 5, out: str = "fold") -> DataFrame:
    """WIN7: unshuffled K-fold on the row order: the first n % k folds get
    n // k + 1 rows, the rest n // k (contiguous blocks)."""
    d = global_rank(df, order_cols)
    n = d.count()
    q, r = divmod(n, k)
    big = r * (q + 1)
    pos = F.col("_pos")
    fold = F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
        F.lit(r) + F.floor((pos - big) / max(q, 1)))
    return d.withColumn(out, fold.cast("int"))


def timeseries_cv(df: DataFrame, order_cols, n_splits: int = 5, by: str | None = None,
                  out: str = "fold") -> DataFrame:
    """WIN8: expanding-window CV.  Row mode (default): test size n // (k+1);
    fold i tests rows [n - (k - i)·t, n - (k - i - 1)·t) and trains on every
    earlier row.  ``by=<period col>`` cuts on whole periods instead.
    Returns the input rows exploded to (fold, role) pairs — each row once
    per fold in which it is used."""
    if by is not None:
        units = df.select(by).distinct()
        ranked = global_rank(units, [by])
        n = ranked.count()
        d = df.join(ranked, by)
    else:
        d = global_rank(df, order_cols)
        n = d.count()
    t = n // (n_splits + 1)
    start0 = n - n_splits * t
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias(out)
    d = d.select("*", folds)
    test_lo = F.lit(start0) + F.col(out) * t
    role = (F.when(F.col("_pos") < test_lo, "train")
            .when(F.col("_pos") < test_lo + t, "test"))
    return d.withColumn("role", role).filter(F.col("role").isNotNull())
