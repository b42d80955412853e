"""Exact quantiles by digit refinement against pandas, for every group shape and
every kind of double."""
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import quantiles as Q

ODD = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       math.inf, -math.inf, 2.0 ** -1000, 2.0 ** -1001, np.nextafter(2.0, 0), np.nextafter(2.0, 3), 2.0 ** 1023, np.nextafter(2.0 ** 512, 0), 1 / 3, -1e-300, 1e300]


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_image_is_the_ordered_bits_and_back(spark):
    rng = np.random.default_rng(2)
    xs = [float(x) for x in ODD] + [float(x) for x in rng.normal(size=200)] + [float(2.0 ** e * s) for e in range(-1074, 1024, 7) for s in (1, -1)]
    xs += [float(x) for x in rng.integers(0, 2047 << 52, 400).view(np.float64)]
    df = spark.createDataFrame([(x,) for x in [*xs, math.nan, None]], "x double").repartition(1)
    got = Q.images(df, {"i": "x"}).select("i", Q.value(F.col("i")).alias("back")).collect()
    assert [r["i"] for r in got[:-2]] == [bits(x) for x in xs]
    assert [r["back"] for r in got[:-2]] == xs
    assert got[-1]["i"] is None and got[-2]["i"] is None


def _fixture(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in [("a", 1), ("b", 2), ("c", 5), ("d", 175), ("e", 3000), (None, 9)]:
        v = np.round(rng.normal(size=n) * 10, 1 if g != "e" else 3)
        for x in v:
            rows.append((g, float(x), float(x) * 2 if rng.random() > 0.2 else None))
    rows.append(("f", None, None))
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    return pdf, spark.createDataFrame(rows, "g string, x double, y double")


@pytest.mark.parametrize("digit", [12, 5])
def test_exact_quantiles_match_pandas(spark, monkeypatch, digit):
    monkeypatch.setattr(Q, "DIGIT_BITS", digit)
    pdf, df = _fixture(spark)
    probs = [0, 0.1, 0.25, 0.5, 0.75, 1.0] if digit > 5 else [0.1, 0.5]
    res = Q.exact_quantiles(df, ["x", "y"], probs, by=["g"]).toPandas()
    assert len(res) == 7 * 2 * len(probs)
    for _, r in res.iterrows():
        s = pdf[pdf.g.isna() if r.g is None else pdf.g == r.g][r.Feature].dropna()
        assert r.n == len(s)
        if len(s) == 0:
            assert pd.isna(r.q)
        else:
            assert abs(s.quantile(r.p) - r.q) < 1e-9
    got = {(r["Feature"], r["p"]): r["q"] for r in Q.exact_quantiles(df, ["x", "y"], probs).collect()}
    for (c, p), q in got.items():
        assert abs(pdf[c].quantile(p) - q) < 1e-9


def test_two_group_columns_and_odd_doubles(spark):
    rows = [(i % 2, "k" if i % 3 else None, float(x), "_v0") for i, x in enumerate(ODD * 5) if math.isfinite(x)] + [(0, "k", math.nan, ""), (9, "z", math.nan, "")]
    df = spark.createDataFrame(rows, "a int, b string, x double, _k0 string")
    pdf = pd.DataFrame(rows, columns=["a", "b", "x", "z"])
    for r in Q.exact_quantiles(df, ["x"], [0.25, 0.5], by=["a", "b"]).collect():
        s = np.sort(pdf[(pdf.a == r["a"]) & (pdf.b.isna() if r["b"] is None else pdf.b == r["b"])].x.dropna())
        assert r["n"] == len(s)
        if len(s):
            k = int((len(s) - 1) * r["p"])
            f = (len(s) - 1) * r["p"] - k
            assert r["q"] == (s[k] + f * (s[k + 1] - s[k]) if f else s[k])
        else:
            assert r["q"] is None


def test_ties_integers_and_empty(spark):
    vals = [1.0] * 50 + [2.0] * 3 + [9.0] * 47
    df = spark.createDataFrame([(v, int(v)) for v in vals], "x double, i int")
    got = {(r["Feature"], r["p"]): r["q"] for r in Q.exact_quantiles(df, ["x", "i"], [0.25, 0.5, 0.51, 0.75]).collect()}
    s = pd.Series(vals)
    assert len(got) == 8
    for (_, p), q in got.items():
        assert abs(s.quantile(p) - q) < 1e-12
    none = df.limit(0)
    assert [(r["q"], r["n"]) for r in Q.exact_quantiles(none, ["x"], [0.5]).collect()] == [(None, 0)]
    assert Q.exact_quantiles(none, ["x"], [0.5], by=["i"]).collect() == []


def test_passes_are_few(spark, monkeypatch):
    """Values over the whole range of doubles: at most six passes of 12 bits."""
    passes = []
    monkeypatch.setattr(Q, "_bins", lambda *a, inner=Q._bins: passes.append(1) or inner(*a))
    rng = np.random.default_rng(4)
    xs = np.concatenate([s * rng.integers(0, 2046 << 52, 4000).view(np.float64) for s in (1, -1)])
    got = Q.quantile_row(spark.createDataFrame(pd.DataFrame({"x": xs})), ["x"], [0.0, 0.3, 1.0])
    assert got["x"][0] == xs.min() and got["x"][2] == xs.max() and len(passes) <= 6
