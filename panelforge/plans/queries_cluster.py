"""Registered queries: scaling and clustering (ML1, AGG24, ML15-21, AGG23,
RPT6-7, CH18-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import cluster as cl
from panelforge.operators import scale as sc
from panelforge.operators import splits as spl
from panelforge.operators import stats
from panelforge.plans import panels
from panelforge.plans.panels import P1_PREDICTORS, table
from panelforge.plans.registry import R, query, rnd
from panelforge.plans.sql_panels import P1_CTE, SPLIT_CTE, with_

SCALE_COLS = ["acctbal_mean", "urgent_share", "qty_mean", "price_mean"]


def _scaled_p1(spark, d):
    p = spl.temporal_split(panels.nation_year_panel(spark, d), "Year")
    params = sc.fit_robust_scaler(p.filter("split = 'train'"), SCALE_COLS)
    return sc.apply_scaler(p, params), params


_SCALE_SQL = with_(P1_CTE, SPLIT_CTE) + ", sp AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 "
    f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in SCALE_COLS) + \
    " FROM ps WHERE split = 'train'), scaled AS (SELECT Code, Year, split, " + ", ".join(
    f"({c} - m_{c}) / s_{c} AS {c}" for c in SCALE_COLS) + " FROM ps, sp)\n"


@query("robust_scale", R(_SCALE_SQL + "SELECT * FROM scaled", SCALE_COLS))
def q_robust_scale(spark, d):
    """ML1: (x - median) / IQR fitted on train rows, applied to all rows."""
    s, _ = _scaled_p1(spark, d)
    return rnd(s.select("Code", "Year", "split", *SCALE_COLS))


@query("scaling_check", R(_SCALE_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS Feature, median({c}) AS median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr "
    f"FROM scaled WHERE split = 'train'" for c in SCALE_COLS), ["median", "iqr"]))
def q_scaling_check(spark, d):
    """AGG24: after scaling, train median 0 and IQR 1 per feature."""
    s, _ = _scaled_p1(spark, d)
    dsc = stats.describe(s.filter("split = 'train'"), SCALE_COLS)
    return rnd(dsc.select("Feature", F.col("q50").alias("median"),
                          (F.col("q75") - F.col("q25")).alias("iqr")))


# ------------------------------------------------------------ embeddings
EMB_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
cs AS (SELECT label AS cl, d, sum(x) AS s FROM u GROUP BY 1, 2),
cn AS (SELECT label AS cl, count(*) AS n, sum(list_sum(list_transform(v, lambda t: t * t))) AS q FROM e GROUP BY 1),
cent AS (SELECT cs.cl, cs.d, cs.s / cn.n AS c FROM cs JOIN cn USING (cl)),
dist AS (SELECT u.vec_id, cent.cl, sum((u.x - cent.c) * (u.x - cent.c)) AS dd
         FROM u JOIN cent ON u.d = cent.d GROUP BY 1, 2),
asg AS (SELECT vec_id, arg_min(cl, dd) AS cluster FROM dist GROUP BY 1),
lab AS (SELECT e.vec_id, e.label, asg.cluster FROM e JOIN asg USING (vec_id))
"""


def _emb(spark, d):
    e = table(spark, d, "embeddings")
    return cl.as_array(e, "embedding", "_x"), len(e.select("embedding").first()[0])


def _nearest_label_centroid(spark, d):
    e, dim = _emb(spark, d)
    cents = cl.centroids(e, "_x", "label", dim)
    keys = sorted(cents)
    a = cl.assign_nearest(e, "_x", [cents[k] for k in keys], "_ci")
    mp = F.create_map(*[v for i, k in enumerate(keys) for v in (F.lit(i), F.lit(k))])
    return a.withColumn("cluster", mp[F.col("_ci")]).drop("_ci"), dim


@query("kmeans_step", "WITH " + EMB_SQL + "SELECT vec_id, label, cluster FROM lab")
def q_kmeans_step(spark, d):
    """ML15 (SQL-checkable step): assignment of every vector to the nearest
    of the given centres (here the per-label means)."""
    a, _ = _nearest_label_centroid(spark, d)
    return a.select("vec_id", "label", "cluster")


@query("kmeans_moves", R("WITH " + EMB_SQL + """,
near AS (SELECT 0 AS model, vec_id, arg_min(cl, dd) AS cl FROM dist GROUP BY 1, 2
         UNION ALL SELECT 1, vec_id, arg_min(cl, dd) FROM dist WHERE cl IN (SELECT label FROM e GROUP BY label ORDER BY label LIMIT 4) GROUP BY 1, 2),
num AS (SELECT cl, row_number() OVER (ORDER BY cl) - 1 AS cluster FROM cn)
SELECT near.model, CAST(num.cluster AS INT) AS cluster, count(*) AS n, CAST(u.d - 1 AS INT) AS dim, avg(u.x) AS value
FROM near JOIN num USING (cl) JOIN u USING (vec_id) GROUP BY 1, 2, 4""", ["value"]))
def q_kmeans_moves(spark, d):
    """ML15, ML16 (SQL-checkable step): centres after one batched move of two models,
    which start from the means of all labels and of the four lowest."""
    e, dim = _emb(spark, d)
    cents = cl.centroids(e, "_x", "label", dim)
    keys = sorted(cents)
    return rnd(cl.kmeans_moves(e, "_x", [[cents[k] for k in keys], [cents[k] for k in keys[:4]]]))


ARI_SQL = """
, ct AS (SELECT label AS t, cluster AS p, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY 1, 2),
ca AS (SELECT t, sum(n) AS a FROM ct GROUP BY t), cb AS (SELECT p, sum(n) AS b FROM ct GROUP BY p),
tot AS (SELECT sum(n) AS nn, sum(n * (n - 1) / 2) AS sij FROM ct),
sa AS (SELECT sum(a * (a - 1) / 2) AS sa, sum(a * ln(a)) AS ha FROM ca),
sb AS (SELECT sum(b * (b - 1) / 2) AS sb, sum(b * ln(b)) AS hb FROM cb),
mi AS (SELECT sum(ct.n * (ln(ct.n) - ln(ca.a) - ln(cb.b))) AS mi FROM ct JOIN ca USING (t) JOIN cb USING (p)),
z AS (SELECT nn, sij, sa, sb, sa * sb / (nn * (nn - 1) / 2) AS ex, (sa + sb) / 2 AS mx,
             mi / nn + ln(nn) AS mi, ln(nn) - ha / nn AS ha, ln(nn) - hb / nn AS hb FROM tot, sa, sb, mi)
SELECT CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END AS ARI,
       CASE WHEN abs(ha) < 1e-15 AND abs(hb) < 1e-15 THEN 1.0 ELSE greatest(mi, 0) / ((ha + hb) / 2) END AS NMI FROM z
"""


@query("ari_nmi", R("WITH " + EMB_SQL + ARI_SQL, ["ARI", "NMI"]))
def q_ari_nmi(spark, d):
    """AGG23: ARI and NMI between the known label and the nearest-centroid
    assignment, from the contingency table only."""
    a, _ = _nearest_label_centroid(spark, d)
    return rnd(stats.ari_nmi(a, "label", "cluster"))


@query("silhouette", R("WITH " + EMB_SQL + """
, dot AS (SELECT u.vec_id, cs.cl, sum(u.x * cs.s) AS xs FROM u JOIN cs ON u.d = cs.d GROUP BY 1, 2),
xn AS (SELECT vec_id, label, list_sum(list_transform(v, lambda t: t * t)) AS nx FROM e),
md AS (SELECT xn.vec_id, xn.label, dot.cl, cn.n, cn.n * xn.nx - 2 * dot.xs + cn.q AS tot
       FROM xn JOIN dot USING (vec_id) JOIN cn ON cn.cl = dot.cl),
ab AS (SELECT vec_id, max(CASE WHEN cl = label THEN tot / greatest(n - 1, 1) END) AS a,
              min(CASE WHEN cl <> label THEN tot / n END) AS b, max(CASE WHEN cl = label THEN n END) AS own
       FROM md GROUP BY vec_id)
SELECT avg(CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab""",
                       ["silhouette"]))
def q_silhouette(spark, d):
    """ML17: squared-Euclidean silhouette of the known labels (decomposed
    into per-cluster sums; no pairs of rows)."""
    e, dim = _emb(spark, d)
    return rnd(cl.silhouette_sq(e, "_x", "label", dim))


@query("inertia_of_partition", R("WITH " + EMB_SQL + """
, per AS (SELECT cl, any_value(cn.n) AS n, any_value(cn.q) AS q, sum(cs.s * cs.s) AS ss
          FROM cs JOIN cn USING (cl) GROUP BY cl)
SELECT sum(q - ss / n) AS inertia FROM per""", ["inertia"]))
def q_inertia(spark, d):
    """ML18: within-cluster sum of squares of the known labels."""
    e, _ = _emb(spark, d)
    return rnd(cl.inertia(e, "_x", "label"))


@query("kmeans")
def q_kmeans(spark, d):
    """ML15: k-means (k = 10, 10 restarts) on the embeddings; labels
    renumbered by smallest id; agreement with the known label."""
    e, _ = _emb(spark, d)
    lab, _, cost = cl.kmeans_fit(e, "_x", 10, seed=42, n_init=10, key="vec_id")
    agree = stats.ari_nmi(lab, "label", "cluster")
    return rnd(agree.withColumn("inertia", F.lit(cost)))


def _entity_profile(spark, d, target=True):
    """Entity profile (AGG1+AGG2) robust-scaled, as an array column."""
    p = panels.nation_year_panel(spark, d)
    prof = stats.group_mean_profile(p, "Code", P1_PREDICTORS, "target" if target else None)
    feats = [c for c in prof.columns if c != "Code"]
    params = sc.fit_robust_scaler(prof, feats)
    s = sc.apply_scaler(prof, params)
    reg = p.select("Code", "Region").distinct()
    return cl.as_array(s, feats, "_x").join(reg, "Code"), feats


@query("kmeans_sweep")
def q_kmeans_sweep(spark, d):
    """ML16 / CH18: inertia and silhouette for k = 2..8 on entity profiles."""
    prof, _ = _entity_profile(spark, d)
    prof = prof.cache()
    sw = cl.kmeans_sweep(prof, "_x", range(2, 9), seed=42, n_init=10, key="Code")
    best_k = sw.agg(F.max_by("k", "silhouette")).first()[0]  # AGG26
    return rnd(sw.withColumn("is_best", F.col("k") == F.lit(best_k)))


@query("pca_coords")
def q_pca(spark, d):
    """ML21 / CH20: 2-component PCA of the entity profiles (centred)."""
    prof, _ = _entity_profile(spark, d)
    coords, ratio = cl.pca_coords(prof, "_x", 2)
    return rnd(coords.select("Code", "Region", "PC1", "PC2").withColumns(
        {"ratio1": F.lit(ratio[0]), "ratio2": F.lit(ratio[1])}))


@query("pca_two_features", R(with_(P1_CTE) + """
, m AS (SELECT var_pop(qty_mean) AS a, covar_pop(qty_mean, price_mean) AS b, var_pop(price_mean) AS c FROM p1),
l AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
             (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM m)
SELECT 1 AS component, l1 / (l1 + l2) AS ratio FROM l UNION ALL SELECT 2, l2 / (l1 + l2) FROM l""", ["ratio"]))
def q_pca_two(spark, d):
    """ML21 (SQL-checkable): explained-variance ratios of a 2-feature PCA."""
    p = panels.nation_year_panel(spark, d)
    x = cl.as_array(p, ["qty_mean", "price_mean"], "_x")
    _, ratio = cl.pca_coords(x, "_x", 2)
    return rnd(spark.createDataFrame([(1, ratio[0]), (2, ratio[1])], "component int, ratio double"))


@query("cluster_region_agreement")
def q_cluster_region(spark, d):
    """RPT7: ARI / NMI of k-means (k = 4) against the regions."""
    prof, _ = _entity_profile(spark, d)
    km, _, _ = cl.kmeans_fit(prof.cache(), "_x", 4, seed=42, n_init=10, key="Code")
    a = stats.ari_nmi(km, "Region", "cluster").withColumn("Method", F.lit("K-Means"))
    return rnd(a.select("Method", "ARI", "NMI"))


@query("cluster_lookup")
def q_cluster_lookup(spark, d):
    """RPT6 / CH20: Code, Cluster label, PC1, PC2, Region."""
    from panelforge.functions.exprs import cluster_label
    prof, _ = _entity_profile(spark, d)
    prof = prof.cache()
    km, _, _ = cl.kmeans_fit(prof, "_x", 4, seed=42, n_init=10, key="Code")
    coords, _ = cl.pca_coords(prof, "_x", 2)
    out = (km.select("Code", cluster_label("cluster").alias("_label"))
           .join(coords.select("Code", "PC1", "PC2", "Region"), "Code")
           .withColumnRenamed("_label", "Cluster"))
    return rnd(out.select("Code", "Cluster", "PC1", "PC2", "Region"))
