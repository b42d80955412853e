"""Shapley explanations (ML31-ML35, AGG21).

Results are long tables (row_id, Feature, phi).  Linear models use the
exact closed form φ_j = β_j·(x_j − E_bg[x_j]).  Other models use the
permutation estimator (Štrumbelj & Kononenko 2014) as one Spark job: each
explained row is paired with S samples (a random feature order and a
background row chosen by hash — an equi-join on the background index, no
cross join), each sample expands to p + 1 hybrid rows (the first k
features of the order taken from x, the rest from the background row),
the model scores all hybrids in ONE ``transform``, and consecutive
differences along the order are the marginal contributions.  Per sample
they telescope exactly to f(x) − f(z).  Symmetric trees have an exact form
(``shap_symmetric``): a row's values depend on its leaves only.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def is_tree_model(model) -> bool:
    """ML35: dispatch on the fitted model family."""
    from pyspark.ml.regression import (DecisionTreeRegressionModel, GBTRegressionModel,
                                       RandomForestRegressionModel)
    inner = getattr(model, "model", model)
    from panelforge.operators.regress import ObliviousBoostModel, TreesModel
    return isinstance(inner, (DecisionTreeRegressionModel, GBTRegressionModel,
                              RandomForestRegressionModel, ObliviousBoostModel, TreesModel))


def shap_linear(x: DataFrame, row_id: str, coef: dict, background: DataFrame) -> DataFrame:
    """ML31: exact Shapley values of a linear model, long (row_id, Feature, phi).
    Background means are one aggregate (a fitted parameter row)."""
    feats = list(coef)
    means = background.agg(*[F.avg(c).alias(c) for c in feats]).first()
    phi = x.select(row_id, *[(F.lit(float(coef[c])) * (F.col(c) - F.lit(float(means[c])))).alias(c)
                             for c in feats])
    return phi.unpivot([row_id], feats, "Feature", "phi")


def shap_permutation(fitted, x: DataFrame, row_id: str, background: DataFrame, features,
                     n_samples: int = 50, n_background: int = 100, seed: int = 42) -> DataFrame:
    """ML32: Monte-Carlo Shapley values for any model with ``transform``.
    ``background`` is sampled to ``n_background`` rows (md5 order of a hash
    of the feature values, so the sample does not depend on partitioning;
    rows that tie are equal); returns (row_id, Feature, phi)."""
    from panelforge.operators.relational import sample_n
    feats = list(features)
    p = len(feats)
    bg = sample_n(background.select(*feats).withColumn("_k", F.xxhash64(*feats)),
                  "_k", n_background, seed)
    bg = bg.withColumn("_bi", F.row_number().over(W.orderBy("_k")) - 1)  # ≤ n_background rows
    nb = bg.count()
    bgz = bg.select("_bi", *[F.col(c).alias(f"_z_{c}") for c in feats])
    s = x.select(row_id, *feats).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    h = F.xxhash64(F.col(row_id).cast("string"), F.col("_s"), F.lit(seed))
    s = s.withColumn("_bi", F.pmod(h, F.lit(nb)))
    # random order of the features: sort feature ids by a per-(row, sample) hash
    order = F.transform(
        F.array_sort(F.array(*[F.struct(F.xxhash64(F.col(row_id).cast("string"), F.col("_s"),
                                                   F.lit(seed + 1), F.lit(j)).alias("h"),
                                        F.lit(j).alias("j")) for j in range(p)])),
        lambda st: st["j"])
    s = s.withColumn("_ord", order).join(F.broadcast(bgz), "_bi")  # nb rows, bounded
    s = s.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(p))))
    # rank of feature j in the order; taken from x when rank < k
    hyb = s.select(row_id, "_s", "_k", "_ord", *[
        F.when(F.array_position(F.col("_ord"), F.lit(j)) <= F.col("_k"), F.col(c))
        .otherwise(F.col(f"_z_{c}")).alias(c) for j, c in enumerate(feats)])
    scored = fitted.transform(hyb)
    w = W.partitionBy(row_id, "_s").orderBy("_k")  # p + 1 rows per partition
    diff = scored.withColumn("_d", F.col("prediction") - F.lag("prediction").over(w)) \
        .filter(F.col("_k") > 0)
    diff = diff.withColumn("_j", F.element_at(F.col("_ord"), F.col("_k").cast("int")))
    names = F.array(*[F.lit(c) for c in feats])
    return (diff.groupBy(row_id, "_j").agg((F.sum("_d") / F.lit(n_samples)).alias("phi"))
            .select(row_id, F.element_at(names, F.col("_j") + 1).alias("Feature"), "phi"))


def _leaf_tables(splits, values, counts) -> dict:
    """Per split feature, its Shapley value in every leaf of one symmetric tree, the
    background given by its rows per leaf.  v(A) of a leaf is the mean leaf value
    once the bits of the features outside A are those of the background."""
    depth, leaves = len(splits), np.arange(len(values))
    feats = sorted({f for f, _ in splits})
    share = counts / max(1, counts.sum())
    mask = {f: sum(1 << (depth - 1 - d) for d, (g, _) in enumerate(splits) if g == f) for f in feats}
    values = np.asarray(values, dtype=float)
    v = {}
    for r in range(len(feats) + 1):
        for a in combinations(feats, r):
            kept = sum(mask[f] for f in a)
            v[a] = values[(leaves[:, None] & kept) | (leaves[None, :] & ~kept)] @ share
    m = len(feats)
    return {f: sum((v[tuple(sorted((*a, f)))] - v[a]) * factorial(len(a)) * factorial(m - len(a) - 1) / factorial(m)
                   for a in v if f not in a) for f in feats}


def shap_symmetric(model, x: DataFrame, row_id: str, background: DataFrame) -> DataFrame:
    """ML32 for symmetric trees (``regress.ObliviousBoostModel``), exact over the whole
    background: long (row_id, Feature, phi).  One aggregate counts the background
    rows per (tree, leaf); from these at most trees x 2^depth numbers the values of
    each leaf are tabled, and explaining is column expressions.  A feature without a
    split has 0, NULL features go left as in prediction; an empty background raises."""
    trees = F.array(*[F.struct(F.lit(i).alias("tree"), model.leaf_expr(splits).alias("leaf")) for i, (splits, _) in enumerate(model.trees)])
    counts = [np.zeros(len(values)) for _, values in model.trees]
    if model.trees:
        for r in background.select(F.explode(trees).alias("t")).groupBy("t.tree", "t.leaf").count().collect():
            counts[r["tree"]][r["leaf"]] = r["count"]
        if not counts[0].sum():
            raise ValueError("shap_symmetric: the background has no rows")
    phi = {f: F.lit(0.0) for f in model.features}
    for (splits, values), n in zip(model.trees, counts):
        leaf = model.leaf_expr(splits) + 1
        for f, table in _leaf_tables(splits, values, n).items():
            phi[f] = phi[f] + F.element_at(F.array(*[F.lit(float(t)) for t in table]), leaf)
    named = {f"_phi{i}": f for i, f in enumerate(model.features)}
    wide = x.select(row_id, *[phi[f].alias(c) for c, f in named.items()]).withColumnsRenamed(named)
    return wide.unpivot([row_id], model.features, "Feature", "phi")


def mean_abs_importance(phi: DataFrame) -> DataFrame:
    """AGG21 / RPT4: mean |φ| per feature, largest first."""
    return (phi.groupBy("Feature").agg(F.avg(F.abs("phi")).alias("Mean_Abs_SHAP"))
            .orderBy(F.desc("Mean_Abs_SHAP"), "Feature"))


def waterfall_table(phi: DataFrame, row_id: str, rid, baseline: float) -> DataFrame:
    """ML33: one row's contributions by |φ| desc with the running value
    from the baseline (p rows)."""
    one = phi.filter(F.col(row_id) == F.lit(rid))
    w = W.orderBy(F.desc(F.abs("phi")), "Feature").rowsBetween(W.unboundedPreceding, W.currentRow)
    return one.select("Feature", "phi", (F.lit(baseline) + F.sum("phi").over(w)).alias("running"),
                      F.row_number().over(W.orderBy(F.desc(F.abs("phi")), "Feature")).alias("step"))


def beeswarm_table(phi: DataFrame, x: DataFrame, row_id: str, features) -> DataFrame:
    """ML34: (row, feature, φ, feature value, feature rank by mean |φ|)."""
    vals = x.select(row_id, *[F.col(c).cast("double").alias(c) for c in features]) \
        .unpivot([row_id], list(features), "Feature", "value")
    imp = phi.groupBy("Feature").agg(F.avg(F.abs("phi")).alias("_imp"))
    rank = imp.withColumn("feature_rank", F.row_number().over(W.orderBy(F.desc("_imp"), "Feature")))
    return phi.join(vals, [row_id, "Feature"]).join(rank.select("Feature", "feature_rank"), "Feature")
