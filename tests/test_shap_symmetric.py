"""Symmetric trees: exact Shapley values against enumeration of all subsets, the split search against a loop."""
import itertools
import math

import numpy as np
import pytest

from panelforge.operators import explain as ex
from panelforge.operators import regress as rg

FEATS = ["a", "b", "c", "unused"]
TREES = [([("a", 0.0), ("b", 0.5), ("a", 1.0)], [0.3, -1.0, 2.0, 0.7, 5.0, -2.5, 1.1, 0.0]),
         ([("c", -0.2), ("b", 0.1)], [1.0, 4.0, -3.0, 0.5]), ([("c", 0.4)], [2.0, -2.0])]


def predict(row):
    out = 1.5
    for splits, values in TREES:
        leaf = 0
        for f, t in splits:
            v = row[FEATS.index(f)]
            leaf = 2 * leaf + (v is not None and v > t)
        out += values[leaf]
    return out


def test_values_equal_enumeration(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(float(v) for v in r) for r in rng.normal(size=(23, 4))] + [(None, 0.2, None, 1.0), (0.5, None, 0.1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, unused double")
    bg = df.filter("id < 9").union(df.filter("id in (2, 24)"))          # a repeated row counts twice
    zs = rows[:9] + [rows[2], rows[24]]
    got = {(r["id"], r["Feature"]): r["phi"] for r in ex.shap_symmetric(rg.ObliviousBoostModel(FEATS, 1.5, TREES), df, "id", bg).collect()}
    assert len(got) == len(rows) * 4
    for i, x in enumerate(rows):
        v = {a: np.mean([predict([x[j] if j in a else z[j] for j in range(4)]) for z in zs])
             for r in range(5) for a in itertools.combinations(range(4), r)}
        for j, f in enumerate(FEATS):
            want = sum((v[tuple(sorted((*a, j)))] - v[a]) * math.factorial(len(a)) * math.factorial(3 - len(a)) / 24 for a in v if j not in a)
            assert got[i, f] == pytest.approx(want, abs=1e-12)
        assert sum(got[i, f] for f in FEATS) == pytest.approx(predict(x) - np.mean([predict(z) for z in zs]), abs=1e-12)


def test_no_background_raises_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0)], "id int, a double, b double, c double, unused double")
    model = rg.ObliviousBoostModel(FEATS, 1.5, TREES)
    with pytest.raises(ValueError):
        ex.shap_symmetric(model, df, "id", df.limit(0))
    assert ex.shap_symmetric(model, df.limit(0), "id", df).isEmpty()
    assert {r["phi"] for r in ex.shap_symmetric(rg.ObliviousBoostModel(FEATS, 1.5, []), df, "id", df).collect()} == {0.0}


@pytest.mark.parametrize("lam", [0.0, 3.0])
def test_split_search_equals_a_loop(lam):
    rng = np.random.default_rng(5)
    for _ in range(20):
        borders = rng.integers(0, 6, size=3).tolist()
        rows = [{"_f": f"_b{f}", "_leaf": leaf, "_bin": b, "G": float(rng.normal()), "n": int(rng.integers(1, 9))}
                for f in range(3) for leaf in (0, 2, 3) for b in range(borders[f] + 1) if rng.random() < 0.8]
        gains = {}
        for f in range(3):
            of = [r for r in rows if r["_f"] == f"_b{f}"]
            for t in range(borders[f] if of else 0):
                total = 0.0
                for leaf in {r["_leaf"] for r in of}:
                    for side in (True, False):
                        part = [r for r in of if r["_leaf"] == leaf and (r["_bin"] <= t) == side]
                        if part:
                            total += sum(r["G"] for r in part) ** 2 / (sum(r["n"] for r in part) + lam)
                gains[f, t] = total
        got = rg._best_split(rows, 3, borders, lam)
        assert got is None and not gains or gains[got] == pytest.approx(max(gains.values()))
