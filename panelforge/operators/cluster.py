"""Clustering and its diagnostics (ML15-21, AGG23 inputs).

Distances to k centres are column expressions over fitted centres (k x d
numbers on the driver, like any model's parameters); nothing forms pairs
of rows.  Silhouette is the squared-Euclidean silhouette (the definition
of Spark's ``ClusteringEvaluator``), which decomposes into per-cluster
sums — exact for that distance, linear in the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import lloyd


# ------------------------------------------------------------------ helpers
def as_array(df: DataFrame, features, out: str = "_x") -> DataFrame:
    """Feature columns (or one array column) -> array<double> column."""
    if isinstance(features, str):
        return df.withColumn(out, F.transform(F.col(features), lambda v: v.cast("double")))
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in features]))


def _dot(x: Column, vec) -> Column:
    lit = F.array(*[F.lit(float(v)) for v in vec])
    return F.aggregate(F.zip_with(x, lit, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _sqnorm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def sq_dist_to(x: Column, center) -> Column:
    """||x - c||² as a JVM expression (c inlined)."""
    lit = F.array(*[F.lit(float(v)) for v in center])
    return F.aggregate(F.zip_with(x, lit, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                       lambda acc, v: acc + v)


def assign_nearest(df: DataFrame, x: str, centers, out: str = "cluster") -> DataFrame:
    """Index of the nearest centre (ties -> lowest index): one Lloyd
    assignment step, pure expressions."""
    d = F.array(*[sq_dist_to(F.col(x), c) for c in centers])
    return df.withColumn(out, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def cluster_sums(df: DataFrame, x: str, label: str, dim: int):
    """Per cluster: n, vector sum, sum of squared norms (k rows)."""
    rows = (df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(x)[i]) for i in range(dim)]).alias("s"),
        F.sum(_sqnorm(F.col(x))).alias("q")).collect())
    return {r[label]: (r["n"], np.array(r["s"], dtype=float), r["q"]) for r in rows}


def centroids(df: DataFrame, x: str, label: str, dim: int) -> dict:
    return {k: s / n for k, (n, s, _) in cluster_sums(df, x, label, dim).items()}


# ------------------------------------------------------------------ metrics
def silhouette_sq(df: DataFrame, x: str, label: str, dim: int) -> DataFrame:
    """ML17: mean squared-Euclidean silhouette.  For point i and cluster C
    the mean squared distance is (n_C·|x|² - 2·x·S_C + Q_C) / n_C, over
    n_C - 1 for its own cluster (the self term is 0); singletons score 0.
    Exact for that distance; one pass after a k-row summary."""
    cs = cluster_sums(df, x, label, dim)
    keys = sorted(cs)
    xn = _sqnorm(F.col(x))
    dists = {}
    for c in keys:
        n, s, q = cs[c]
        dists[c] = (xn * n - 2 * _dot(F.col(x), s) + q)
    own_n = F.col("_own_n")
    d = df.withColumn("_own_n", F.create_map(*[v for c in keys for v in (F.lit(c), F.lit(cs[c][0]))])
                      [F.col(label)])
    a = F.coalesce(*[F.when(F.col(label) == F.lit(c), dists[c] / F.greatest(own_n - 1, F.lit(1)))
                     for c in keys])
    others = [F.when(F.col(label) != F.lit(c), dists[c] / cs[c][0]) for c in keys]
    b = F.least(*others) if len(others) > 1 else others[0]
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return d.agg(F.avg(s).alias("silhouette"))


def inertia(df: DataFrame, x: str, label: str) -> DataFrame:
    """ML18: within-cluster sum of squares = Σ|x|² - Σ_C |S_C|²/n_C,
    from per-cluster sums (no join, no pairs)."""
    first = df.select(F.size(x).alias("d")).first()
    dim = first["d"] if first else 0
    per = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_sqnorm(F.col(x))).alias("q"),
        *[F.sum(F.col(x)[i]).alias(f"s{i}") for i in range(dim)])
    ss = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)), F.lit(0.0))
    return per.agg(F.sum(F.col("q") - ss / F.col("n")).alias("inertia"))


# ------------------------------------------------------------------- k-means
def kmeans_fit(df: DataFrame, x: str, k: int, seed: int = 42, n_init: int = 10,
               key: str | None = None, max_iter: int = 300):
    """ML15: k-means, ``n_init`` restarts moved together (``operators/lloyd.py``);
    the lowest cost wins.  Labels are renumbered by the smallest ``key`` in
    each cluster so they are stable; a row with a NULL vector has a NULL label.
    Returns (DataFrame with ``cluster``, centres in label order, cost); without
    any vector all labels are NULL, there are no centres and the cost is 0."""
    data = lloyd.vectors(df, x, key).persist()
    try:
        found = lloyd.best_models(data, [k], seed, n_init, max_iter)
    finally:
        data.unpersist()
    if not found:
        return df.withColumn("cluster", F.lit(None).cast("int")), [], 0.0
    centres, sums = found[k]
    pred = assign_nearest(df, x, centres, "_p")
    order = list(range(len(centres)))
    if key is not None:
        mins = {r["_p"]: r["m"] for r in pred.filter("_p is not null").groupBy("_p").agg(F.min(key).alias("m")).collect()}
        order = sorted(mins, key=lambda p: mins[p])
    relabel = F.create_map(*[v for i, p in enumerate(order) for v in (F.lit(p), F.lit(i))])
    return (pred.withColumn("cluster", relabel[F.col("_p")].cast("int")).drop("_p"),
            [centres[p] for p in order], float(sums.cost.sum()))


def kmeans_sweep(df: DataFrame, x: str, ks=range(2, 9), seed: int = 42, n_init: int = 10,
                 key: str | None = None, max_iter: int = 300) -> DataFrame:
    """ML16: (k, inertia, silhouette) for each k; all (k, restart) models move in
    one pass per iteration, and one pass gives the silhouettes of all k."""
    data = lloyd.vectors(df, x, key).persist()
    try:
        models = lloyd.best_models(data, list(ks), seed, n_init, max_iter)
        scores = lloyd.silhouettes(data, list(models.values())) if models else []
    finally:
        data.unpersist()
    rows = [(int(k), float(sums.cost.sum()), None if sil is None else float(sil))
            for (k, (_, sums)), sil in zip(models.items(), scores)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def kmeans_moves(df: DataFrame, x: str, models) -> DataFrame:
    """One batched move of several models, given as lists of centres: long
    (model, cluster, n, dim, value) of the centres after it; empty clusters left out."""
    models = [np.asarray(c, dtype=float) for c in models]
    rows = [(m, j, int(t.n[j]), i, float(v)) for m, (c, t) in enumerate(zip(models, lloyd.sums_by_cluster(lloyd.vectors(df, x, None), models)))
            for j in np.flatnonzero(t.n).tolist() for i, v in enumerate(lloyd.move(t, c)[j])]
    return df.sparkSession.createDataFrame(rows, "model int, cluster int, n long, dim int, value double")


# ----------------------------------------------------------------------- PCA
def pca_coords(df: DataFrame, x: str, k: int = 2):
    """ML21: PCA on centred features (Spark's PCA does not centre).
    Components are sign-fixed so the largest-magnitude loading is
    positive.  Returns (coords DF with PC1..PCk, explained ratio list)."""
    from pyspark.ml.feature import PCA
    dim = df.select(F.size(x).alias("d")).first()["d"]
    means = np.array(df.agg(F.array(*[F.avg(F.col(x)[i]) for i in range(dim)]).alias("m"))
                     .first()["m"], dtype=float)
    centred = df.withColumn("_c", F.zip_with(F.col(x), F.array(*[F.lit(float(m)) for m in means]),
                                             lambda a, b: a - b))
    data = centred.withColumn("_v", array_to_vector("_c"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(data)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(data).withColumn("_pa", vector_to_array("_pc"))
    out = out.withColumns({f"PC{j + 1}": F.col("_pa")[j] * F.lit(signs[j]) for j in range(k)})
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    return out.drop("_c", "_v", "_pc", "_pa"), ratio


def assemble(df: DataFrame, columns, out: str = "features") -> DataFrame:
    """ML boundary: numeric columns -> one vector column."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)
