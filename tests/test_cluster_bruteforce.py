"""Clustering diagnostics vs direct NumPy formulas on small fixtures."""
import itertools
import math

import numpy as np
import pytest

from panelforge.operators import cluster as cl
from panelforge.operators import lloyd
from panelforge.operators import stats


def _ari_nmi(a, b):
    n = len(a)
    ca, cb = sorted(set(a)), sorted(set(b))
    m = np.array([[sum(1 for x, y in zip(a, b) if x == i and y == j) for j in cb] for i in ca], float)
    comb = lambda v: v * (v - 1) / 2
    sij, sa, sb = comb(m).sum(), comb(m.sum(1)).sum(), comb(m.sum(0)).sum()
    exp = sa * sb / comb(n)
    ari = (sij - exp) / ((sa + sb) / 2 - exp)
    pa, pb, pij = m.sum(1) / n, m.sum(0) / n, m / n
    mi = sum(pij[i, j] * math.log(pij[i, j] / (pa[i] * pb[j]))
             for i in range(len(ca)) for j in range(len(cb)) if pij[i, j] > 0)
    ha, hb = -(pa * np.log(pa)).sum(), -(pb * np.log(pb)).sum()
    return ari, mi / ((ha + hb) / 2)


def test_ari_nmi_match_formulas(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 4, size=120).tolist()
    b = [(x + (1 if rng.random() < 0.3 else 0)) % 5 for x in a]
    df = spark.createDataFrame(list(zip(range(120), a, b)), "id int, a int, b int")
    r = stats.ari_nmi(df, "a", "b").first()
    ari, nmi = _ari_nmi(a, b)
    assert r.ARI == pytest.approx(ari, abs=1e-12) and r.NMI == pytest.approx(nmi, abs=1e-12)


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4)) @ np.array([[3, 0, 0, 0], [1, 1, 0, 0], [0, 0, 0.5, 0], [0, 0, 0, 0.1]])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    coords, ratio = cl.pca_coords(df, "v", 2)
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    assert ratio == pytest.approx((s[:2] ** 2 / (s ** 2).sum()).tolist(), rel=1e-9)
    for j in range(2):
        comp = vt[j] * np.sign(vt[j][np.argmax(np.abs(vt[j]))])   # largest loading positive
        ref = xc @ comp
        got = [r[f"PC{j + 1}"] for r in coords.orderBy("id").collect()]
        assert got == pytest.approx(ref.tolist(), abs=1e-9)


def test_lloyd_moves_all_models_like_a_loop(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.6, size=(40, 3)) for c in (-4, 0, 3, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, v array<double>").repartition(5)
    data = lloyd.vectors(df, "v", "id")
    assert data.count() == len(x)
    starts = [x[:k] for k in (1, 2, 4, 6)]
    passes = []
    got = lloyd.lloyd(data, starts, on_pass=passes.append)
    need = []
    for start, (centres, sums) in zip(starts, got):
        c = start.copy()
        for step in itertools.count(1):
            own = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
            after = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
            if ((after - c) ** 2).sum(1).max() <= 1e-12:
                break
            c = after
        need.append(step)
        assert centres == pytest.approx(c, abs=1e-9)
        assert sums.n.tolist() == np.bincount(own, minlength=len(c)).tolist()
        assert sums.cost.sum() == pytest.approx(((x - c[own]) ** 2).sum())
    # a converged model leaves: a pass moves those that still need it
    assert passes == [sum(n > t for n in need) for t in range(max(need))]
    for (centres, _), sil in zip(got, lloyd.silhouettes(data, got)):
        own = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        d = ((x[:, None] - x) ** 2).sum(-1)
        if len(centres) == 1:
            assert sil is None
            continue
        each = []
        for i, o in enumerate(own):
            a = d[i, own == o].sum() / max(1, (own == o).sum() - 1)
            b = min(d[i, own == j].mean() for j in set(own.tolist()) - {o})
            each.append((b - a) / max(a, b) if (own == o).sum() > 1 else 0.0)
        assert sil == pytest.approx(np.mean(each))


def test_lloyd_cap_on_moves_keeps_the_given_number(spark):
    x = np.random.default_rng(12).normal(size=(80, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    (centres, sums), = lloyd.lloyd(lloyd.vectors(df, "v", "id"), [x[:5]], max_iter=2)
    c = x[:5]
    for _ in range(2):
        own = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        c = np.array([x[own == j].mean(0) for j in range(5)])
    assert centres == pytest.approx(c) and sums.n.sum() == 80


def test_seeds_are_rows_drawn_by_distance(spark):
    # three far groups: the second and third centre come from groups not yet drawn
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(c, 0.01, size=(30, 2)) for c in (0, 100, 10000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    data = lloyd.vectors(df, "v", "id")
    seeds = lloyd.seed_centres(data, 3, range(12))
    for s in seeds:
        assert all((s[j] == x).all(1).any() for j in range(3))
        assert sorted(np.abs(s[:, :1] - [0, 100, 10000]).argmin(1).tolist()) == [0, 1, 2]
    assert len({tuple(s[0]) for s in seeds}) > 6
    again = lloyd.seed_centres(data.repartition(7), 3, range(12))
    assert all((a == b).all() for a, b in zip(seeds, again))


def test_kmeans_edge_cases(spark):
    schema = "id int, v array<double>"
    few = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [5.0]), (4, None)], schema)
    lab, centres, cost = cl.kmeans_fit(few, "v", 4, n_init=2, key="id")
    assert {r["id"]: r["cluster"] for r in lab.collect()} == {1: 0, 2: 0, 3: 1, 4: None}
    assert sorted(c[0] for c in centres) == [0.0, 5.0] and cost == 0.0
    empty = few.limit(0)
    assert cl.kmeans_fit(empty, "v", 2, key="id")[1] == [] and cl.kmeans_sweep(empty, "v", [2, 3]).isEmpty()
    sweep = {r["k"]: r for r in cl.kmeans_sweep(few, "v", [1, 2, 3], n_init=2, key="id").collect()}
    assert sweep[1]["silhouette"] is None and sweep[2]["inertia"] == 0.0
    assert sweep[2]["silhouette"] == pytest.approx(2 / 3) == sweep[3]["silhouette"]
