"""Time-ordered operators (WIN1-4, WIN9-10) and the segmented scans
they are built on.

Skew rule: an entity may hold a large share of the rows, so nothing here
puts a whole entity into one window partition.  Ordered scans run per
(entity, bucket) where ``bucket`` slices the period axis; the carry
between buckets comes from a window over one summary row per bucket.
Per-entity fits (OLS slope/intercept, counts) are ordinary grouped
aggregates, which combine partial results map side.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

UNB_P, UNB_F, CUR = W.unboundedPreceding, W.unboundedFollowing, W.currentRow

#: Rows that a bucket of the densest entity should have, if its periods are spread evenly.
BUCKET_ROWS = 4096


def bucket_width(df: DataFrame, entity: str, period: str, rows: int = BUCKET_ROWS) -> float:
    """Width of a period bucket, in period units: the one at which the densest
    entity has ``rows`` rows a bucket.  A panel of short series is one bucket."""
    per = F.col(period).cast("double")
    n, span = F.count(per), F.max(per) - F.min(per) + 1
    dense = df.groupBy(entity).agg((n / span).alias("rate")).agg(F.max("rate")).first()[0]
    return max(1.0, math.ceil(rows / dense)) if dense else 1.0


def _bucket(period: str, width: float) -> Column:
    return F.floor(F.col(period).cast("double") / F.lit(float(width))).cast("long")


def row_position(df: DataFrame, entity: str, period: str, width: float | None = None,
                 out: str = "_rn") -> DataFrame:
    """1-based position of each row within its entity, ordered by period (NULL
    first): local row_number per (entity, bucket) + the row count of all earlier
    buckets (a window over bucket summaries).  The width of the buckets comes from the data
    unless given.  A NULL entity is an entity."""
    d = df.withColumn("_b", _bucket(period, width or bucket_width(df, entity, period)))
    d = d.withColumn("_lrn", F.row_number().over(W.partitionBy(entity, "_b").orderBy(period)))
    sizes = d.groupBy(F.col(entity).alias("_se"), F.col("_b").alias("_sb")).agg(F.count(F.lit(1)).alias("_bn"))
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(
        W.partitionBy("_se").orderBy("_sb").rowsBetween(UNB_P, -1)), F.lit(0)))
    d = d.join(sizes, d[entity].eqNullSafe(sizes["_se"]) & d["_b"].eqNullSafe(sizes["_sb"]))
    return d.withColumn(out, F.col("_off") + F.col("_lrn")).drop("_off", "_lrn", "_se", "_sb", "_bn")


def with_lags(df: DataFrame, entity: str, lags: Mapping[str, Iterable[int]], pos: str = "_rn", rows: int = BUCKET_ROWS) -> DataFrame:
    """``{c}_lag{k}``: the value of column ``c`` k rows earlier in its entity, for all
    columns and lags in one exchange.

    Rows are dealt by (entity, block of positions); the last rows of a block, as many
    as the longest lag, also go to the next block as its halo, and within a block
    a lag is a plain ``lag``.  ``pos`` has positions 1, 2, ... (:func:`row_position`)."""
    lags = {c: sorted(set(ks)) for c, ks in lags.items()}
    longest = max((k for ks in lags.values() for k in ks), default=0)
    if longest < 1:
        return df
    rows = max(rows, 4 * longest)
    block = F.floor((F.col(pos) - 1) / rows).cast("long")
    halo = F.col(pos) > (block + 1) * rows - longest
    own, copy = (F.struct((block + i).alias("_block"), F.lit(i == 1).alias("_halo")) for i in (0, 1))
    d = df.withColumn("_h", F.explode(F.when(halo, F.array(own, copy)).otherwise(F.array(own)))).select(*df.columns, "_h._block", "_h._halo")
    order = W.partitionBy(entity, "_block").orderBy(pos)
    d = d.withColumns({f"{c}_lag{k}": F.lag(c, k).over(order) for c, ks in lags.items() for k in ks})
    return d.filter(~F.col("_halo")).drop("_block", "_halo")


def prev_next_known(d: DataFrame, entity: str, period: str, value: str, pos: str = "_rn"):
    """Adds, for every row, the last known (non-NULL) value at or before
    it and the first known value at or after it, with their positions:
    _lv/_li and _nv/_ni.  ``d`` must carry ``_b`` (bucket) and ``pos``."""
    known_pos = F.when(F.col(value).isNotNull(), F.col(pos))
    d = d.withColumn("_kp", known_pos)
    wl = W.partitionBy(entity, "_b").orderBy(period)
    d = d.withColumns({
        "_lv0": F.last(value, ignorenulls=True).over(wl.rowsBetween(UNB_P, CUR)),
        "_li0": F.last("_kp", ignorenulls=True).over(wl.rowsBetween(UNB_P, CUR)),
        "_nv0": F.first(value, ignorenulls=True).over(wl.rowsBetween(CUR, UNB_F)),
        "_ni0": F.first("_kp", ignorenulls=True).over(wl.rowsBetween(CUR, UNB_F)),
    })
    summ = d.groupBy(entity, "_b").agg(
        F.max_by(value, "_kp").alias("_blv"), F.max("_kp").alias("_bli"),
        F.min_by(value, "_kp").alias("_bfv"), F.min("_kp").alias("_bfi"))
    wb = W.partitionBy(entity).orderBy("_b")
    summ = summ.select(
        entity, "_b",
        F.last("_blv", ignorenulls=True).over(wb.rowsBetween(UNB_P, -1)).alias("_clv"),
        F.last("_bli", ignorenulls=True).over(wb.rowsBetween(UNB_P, -1)).alias("_cli"),
        F.first("_bfv", ignorenulls=True).over(wb.rowsBetween(1, UNB_F)).alias("_cnv"),
        F.first("_bfi", ignorenulls=True).over(wb.rowsBetween(1, UNB_F)).alias("_cni"))
    d = d.join(summ, [entity, "_b"])
    has_l = F.col("_li0").isNotNull()
    has_n = F.col("_ni0").isNotNull()
    return d.select(
        *[c for c in d.columns if not c.startswith("_") or c in ("_b", pos)],
        F.when(has_l, F.col("_lv0")).otherwise(F.col("_clv")).alias("_lv"),
        F.when(has_l, F.col("_li0")).otherwise(F.col("_cli")).alias("_li"),
        F.when(has_n, F.col("_nv0")).otherwise(F.col("_cnv")).alias("_nv"),
        F.when(has_n, F.col("_ni0")).otherwise(F.col("_cni")).alias("_ni"))


def impute_trend(df: DataFrame, columns, entity: str = "Country", period: str = "Year",
                 boundary: str = "flat_trailing", width: float | None = None) -> DataFrame:
    """WIN1 / WIN1b: fill gaps of each column per entity.

    ``boundary='flat_trailing'`` (what the upstream code actually does):
      * interior gaps: linear in row *position* between the neighbours;
      * trailing gaps: copy of the last known value;
      * leading gaps: OLS line (value ~ period) fitted on the series after
        the two steps above (so ``>= 2`` filled points); with one known
        point the gap takes that value; with none it stays NULL.
    ``boundary='ols'`` (what its documentation promises): interior as
    above, both leading and trailing gaps from the OLS line fitted on
    the originally known points only.
    Known values are never changed.

    All columns go through each stage together — one window pass per
    (entity, bucket), one bucket-summary aggregate and carry window, one
    per-entity fit aggregate — so the number of shuffles does not grow
    with the number of imputed columns.
    """
    cols = list(columns)
    d = row_position(df, entity, period, width)
    wl = W.partitionBy(entity, "_b").orderBy(period)
    d = d.withColumns({f"_kp{i}": F.when(F.col(c).isNotNull(), F.col("_rn")) for i, c in enumerate(cols)})
    local = {}
    for i, c in enumerate(cols):
        local[f"_lv0_{i}"] = F.last(c, ignorenulls=True).over(wl.rowsBetween(UNB_P, CUR))
        local[f"_li0_{i}"] = F.last(f"_kp{i}", ignorenulls=True).over(wl.rowsBetween(UNB_P, CUR))
        local[f"_nv0_{i}"] = F.first(c, ignorenulls=True).over(wl.rowsBetween(CUR, UNB_F))
        local[f"_ni0_{i}"] = F.first(f"_kp{i}", ignorenulls=True).over(wl.rowsBetween(CUR, UNB_F))
    d = d.withColumns(local)
    summ = d.groupBy(entity, "_b").agg(*[a for i, c in enumerate(cols) for a in (
        F.max_by(c, f"_kp{i}").alias(f"_blv{i}"), F.max(f"_kp{i}").alias(f"_bli{i}"),
        F.min_by(c, f"_kp{i}").alias(f"_bfv{i}"), F.min(f"_kp{i}").alias(f"_bfi{i}"))])
    wb = W.partitionBy(entity).orderBy("_b")
    carry = [entity, "_b"]
    for i in range(len(cols)):
        carry += [F.last(f"_blv{i}", ignorenulls=True).over(wb.rowsBetween(UNB_P, -1)).alias(f"_clv{i}"),
                  F.last(f"_bli{i}", ignorenulls=True).over(wb.rowsBetween(UNB_P, -1)).alias(f"_cli{i}"),
                  F.first(f"_bfv{i}", ignorenulls=True).over(wb.rowsBetween(1, UNB_F)).alias(f"_cnv{i}"),
                  F.first(f"_bfi{i}", ignorenulls=True).over(wb.rowsBetween(1, UNB_F)).alias(f"_cni{i}")]
    d = d.join(summ.select(*carry), [entity, "_b"])
    filled_cols, fit_aggs = {}, []
    per = F.col(period).cast("double")
    for i, c in enumerate(cols):
        has_l, has_n = F.col(f"_li0_{i}").isNotNull(), F.col(f"_ni0_{i}").isNotNull()
        lv = F.when(has_l, F.col(f"_lv0_{i}")).otherwise(F.col(f"_clv{i}"))
        li = F.when(has_l, F.col(f"_li0_{i}")).otherwise(F.col(f"_cli{i}"))
        nv = F.when(has_n, F.col(f"_nv0_{i}")).otherwise(F.col(f"_cnv{i}"))
        ni = F.when(has_n, F.col(f"_ni0_{i}")).otherwise(F.col(f"_cni{i}"))
        x = F.col(c)
        interior = lv + (nv - lv) * ((F.col("_rn") - li) / (ni - li))
        both = lv.isNotNull() & nv.isNotNull()
        if boundary == "ols":
            filled_cols[f"_fx{i}"] = F.when(x.isNotNull(), x).when(both, interior)
            y = x
        else:
            filled_cols[f"_fx{i}"] = F.when(x.isNotNull(), x).when(both, interior).otherwise(lv)
            y = F.col(f"_fx{i}")
        fit_aggs.append((i, y))
    d = d.withColumns(filled_cols)
    fit = d.groupBy(entity).agg(*[a for i, y in fit_aggs for a in (
        F.count(y).alias(f"_kn{i}"), F.regr_slope(y, per).alias(f"_sl{i}"),
        F.regr_intercept(y, per).alias(f"_ic{i}"),
        F.min_by(y, F.when(y.isNotNull(), F.col("_rn"))).alias(f"_one{i}"))])
    d = d.join(fit, entity, "left")
    out = {}
    for i, c in enumerate(cols):
        line = F.col(f"_ic{i}") + F.col(f"_sl{i}") * per
        out[c] = (F.when(F.col(f"_fx{i}").isNotNull(), F.col(f"_fx{i}"))
                  .when(F.col(f"_kn{i}") >= 2, line).when(F.col(f"_kn{i}") == 1, F.col(f"_one{i}")))
    d = d.withColumns(out)
    keep = [c for c in df.columns]
    return d.select(*keep)


def last_value_per_entity(df: DataFrame, entity: str, period: str, value: str,
                          out: str = "last_value") -> DataFrame:
    """WIN2: value at the latest period of each entity (``max_by``;
    partial aggregation, safe for a hot entity)."""
    return df.groupBy(entity).agg(F.max(period).alias("last_period"),
                                  F.max_by(value, period).alias(out))


def naive_persistence(train: DataFrame, future: DataFrame, entity: str, period: str,
                      target: str) -> DataFrame:
    """WIN3 + JN9: predict every future row by the entity's last train
    value; entities without train rows are dropped (inner join)."""
    last = last_value_per_entity(train.filter(F.col(target).isNotNull()), entity, period,
                                 target, "predicted")
    return future.join(last.select(entity, "predicted"), entity, "inner")


def trend_with_connector(actual: DataFrame, forecasts: DataFrame, entity: str, period: str,
                         value: str, model_col: str = "Series",
                         actual_label: str = "Actual") -> DataFrame:
    """WIN4 / RPT3: history rows + for each (model, entity) a connector row
    copying the last actual point + the forecast rows.  Entities with no
    history are dropped from the forecast series (inner join)."""
    hist = actual.select(entity, period, F.col(value).alias("Rate"),
                         F.lit(actual_label).alias(model_col))
    last = actual.groupBy(entity).agg(F.max(period).alias(period),
                                      F.max_by(value, period).alias("Rate"))
    models = forecasts.select(entity, model_col).distinct()
    conn = last.join(models, entity, "inner").select(entity, period, "Rate", model_col)
    fc = (forecasts.join(last.select(entity), entity, "left_semi")
          .select(entity, period, F.col(value).alias("Rate"), model_col))
    return hist.unionByName(conn).unionByName(fc)


def horizon_index(future: DataFrame, entity: str, period: str, out: str = "h") -> DataFrame:
    """WIN9: forecast step (1, 2, ...) of each future row per entity."""
    return row_position(future, entity, period, out=out).drop("_b").withColumn(out, F.col(out).cast("int"))


def lag_by_halo(df: DataFrame, entity: str, period: str, value: str, lags=(1,)) -> DataFrame:
    """``{value}_lag{k}``: the value k rows earlier in the entity (period
    order), four exchanges for any number of lags (:func:`with_lags`)."""
    d = row_position(df, entity, period).drop("_b")
    return with_lags(d, entity, {value: lags}).drop("_rn")


def lag_diff(df: DataFrame, entity: str, period: str, value: str, lags=(1,)) -> DataFrame:
    """WIN10: lags and the first difference of ``value`` per entity."""
    lags = sorted(set(lags) | {1})
    d = lag_by_halo(df, entity, period, value, lags)
    return d.withColumn(f"{value}_diff", F.col(value) - F.col(f"{value}_lag1"))
