"""Lags by halo exchange, recurrences by affine scan and ARIMAX against plain loops."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import forecast as fc
from panelforge.operators import timeorder as tw
from panelforge.operators.recurrence import final_state, linear_recurrence


def series(rng, sizes):
    return {e: [(t, None if rng.random() < 0.1 else rng.gauss(0, 1)) for t in sorted(rng.sample(range(10 * n + 5), n))] for e, n in sizes.items()}


@pytest.mark.parametrize("rows, width", [(4096, None), (8, 7.0)])
def test_lags_by_halo(spark, rows, width):
    data = series(random.Random(1), {"a": 90, "b": 1, None: 5, "c": 33})
    df = spark.createDataFrame([(e, t, x, "k") for e, s in data.items() for t, x in s], "e string, t int, x double, _extra string").repartition(3)
    d = tw.with_lags(tw.row_position(df, "e", "t", width).drop("_b"), "e", {"x": [1, 2, 5], "t": [3]}, rows=rows)
    got = {(r["e"], r["t"]): r for r in d.collect()}
    assert len(got) == d.count() == 129
    for e, s in data.items():
        for i, (t, _) in enumerate(s):
            r = got[e, t]
            assert r["_rn"] == i + 1 and r["t_lag3"] == (s[i - 3][0] if i >= 3 else None)
            assert [r[f"x_lag{k}"] for k in (1, 2, 5)] == [s[i - k][1] if i >= k else None for k in (1, 2, 5)]


def test_lags_need_four_exchanges(spark):
    df = spark.range(1000).selectExpr("id % 7 AS e", "id AS t", "rand() AS x")
    d = tw.with_lags(tw.row_position(df, "e", "t", 50.0), "e", {"x": [1, 2, 3, 4]})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4


def test_bucket_width_follows_the_densest_entity(spark):
    df = spark.createDataFrame([("a", t) for t in range(0, 1000, 10)] + [("b", t) for t in range(500)] + [("c", 3)], "e string, t int")
    assert tw.bucket_width(df.filter("e <> 'c'"), "e", "t", 50) == 50
    assert tw.bucket_width(df.limit(0), "e", "t") == 1.0


def loop(xs, coef, state):
    ys, state = [], list(state)
    for x in xs:
        y = x + sum(a * s for a, s in zip(coef, state))
        ys.append(y)
        state = [y, *state][:len(state)]
    return ys, state


@pytest.mark.parametrize("rows", [4096, 4])
@pytest.mark.parametrize("order", [1, 3])
def test_linear_recurrence(spark, rows, order):
    rng = random.Random(order)
    data = {e: ([rng.gauss(0, 1) for _ in range(n)], [rng.uniform(-0.4, 0.4) for _ in range(order)], [rng.gauss(0, 1) for _ in range(order)])
            for e, n in {"a": 50, "b": 1, None: 13, "d": 4}.items()}
    df = spark.createDataFrame([(e, i + 1, x, c, s, f"k{i}") for e, (xs, c, s) in data.items() for i, x in enumerate(xs)],
                               "e string, pos long, x double, c array<double>, s array<double>, keep string").repartition(3)
    got = {(r["e"], r["keep"]): r["y"] for r in linear_recurrence(df, "e", "pos", "x", "c", "s", "y", ["keep"], rows).collect()}
    ends = {r["e"]: r["s"] for r in final_state(df, "e", "pos", "x", "c", "s", "s", rows).collect()}
    assert len(got) == 68
    for e, (xs, c, s) in data.items():
        ys, state = loop(xs, c, s)
        np.testing.assert_allclose([got[e, f"k{i}"] for i in range(len(xs))], ys, atol=1e-12)
        np.testing.assert_allclose(ends[e], state, atol=1e-12)
    none = df.limit(0)
    assert linear_recurrence(none, "e", "pos", "x", "c", "s", "y").collect() == [] == final_state(none, "e", "pos", "x", "c", "s", "s").collect()


def brute_arimax(ys, xs, order, future):
    """Hannan-Rissanen and the walk forward, step by step."""
    p, _, q = order
    dy, dx = np.diff(ys), np.diff(xs)
    m = max(p + q, 2) if q else 0

    def ols(rows, target):
        return np.linalg.solve(rows.T @ rows, rows.T @ target)

    e = np.full(len(dy), np.nan)
    if q:
        first = [[*(dy[t - k] for k in range(1, m + 1)), dx[t]] for t in range(m, len(dy))]
        e[m:] = dy[m:] - np.array(first) @ ols(np.array(first), dy[m:])
    at = [t for t in range(max(p, 0), len(dy)) if not q or t - q >= m]
    rows = np.array([[*(dy[t - k] for k in range(1, p + 1)), *(e[t - k] for k in range(1, q + 1)), dx[t]] for t in at])
    c = ols(rows, dy[at])
    phi, theta, beta = c[:p], c[p:p + q], c[p + q]
    if q:
        theta = fc.invertible(theta)
    inn = np.zeros(len(dy))
    for t in range(p, len(dy)):
        inn[t] = dy[t] - sum(phi[k] * dy[t - 1 - k] for k in range(p)) - beta * dx[t] - sum(theta[k] * inn[t - 1 - k] for k in range(q) if t - 1 - k >= 0)
    level, d, inn, before, out = ys[-1], list(dy[::-1]), list(inn[::-1]), xs[-1], []
    for x in future:
        step = sum(phi[k] * d[k] for k in range(p)) + sum(theta[k] * inn[k] for k in range(q)) + beta * (x - before)
        level, d, inn, before = level + step, [step, *d], [0.0, *inn], x
        out.append(level)
    return phi, theta, beta, out


@pytest.mark.parametrize("order", [(1, 1, 0), (2, 1, 1), (0, 1, 2)])
def test_arimax_against_loops(spark, order):
    rng = np.random.default_rng(sum(order))
    data = {}
    for e in "abc":
        xs, noise = rng.normal(size=70).cumsum(), rng.normal(size=70)
        ys = np.cumsum(0.5 * np.diff(xs, prepend=0) + noise + 0.4 * np.concatenate([[0], noise[:-1]]))
        data[e] = (xs, ys)
    rows = [(e, 1990 + t, float(ys[t]), float(xs[t])) for e, (xs, ys) in data.items() for t in range(70)]
    df = spark.createDataFrame(rows, "e string, t int, y double, x double")
    train, future = df.filter("t < 2050"), df.filter("t >= 2050").drop("y")
    model = fc.fit_arimax(train, "e", "t", "y", ["x"], order)
    got = {(r["e"], r["t"]): r["f"] for r in fc.forecast_arimax(model, future, "e", "t", ["x"], "f").collect()}
    for r in model.collect():
        xs, ys = data[r["e"]]
        phi, theta, beta, want = brute_arimax(ys[:60], xs[:60], order, xs[60:])
        np.testing.assert_allclose([*r["phi"], *r["theta"], *r["beta"]], [*phi, *theta, beta], rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose([got[r["e"], 2050 + i] for i in range(10)], want, rtol=1e-7, atol=1e-7)


def test_unknown_entity_raises(spark):
    df = spark.createDataFrame([("a", t, float(t % 5 + t)) for t in range(30)], "e string, t int, y double")
    model = fc.fit_arimax(df, "e", "t", "y", (), (1, 1, 0))
    future = spark.createDataFrame([("a", 30), ("zz", 30)], "e string, t int")
    with pytest.raises(KeyError, match="zz"):
        fc.forecast_arimax(model, future, "e", "t")
    assert [r["e"] for r in fc.forecast_arimax(model, future, "e", "t", strict=False).collect()] == ["a"]


def test_models_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(e, t, float((t * 7) % 11 + t)) for e in "ab" for t in range(40)], "e string, t int, y double")
    model = fc.fit_arimax(df, "e", "t", "y", (), (1, 1, 1))
    path = str(tmp_path / "models")
    fc.save_forecast_models(model, path)
    ahead = fc.periods_after(df, "e", "t", 3)
    assert sorted(map(tuple, ahead.collect())) == [(e, t) for e in "ab" for t in (40, 41, 42)]
    want, got = (sorted(map(tuple, fc.forecast_arimax(m, ahead, "e", "t").collect())) for m in (model, fc.load_forecast_models(spark, path)))
    assert want == got and len(got) == 6
    model.withColumn("_format", F.lit(0)).write.parquet(path + "-old")
    with pytest.raises(ValueError, match="format 0"):
        fc.load_forecast_models(spark, path + "-old")


def test_invertible_keeps_autocorrelations():
    for theta in ([2.0], [0.5], [-3.0, 0.4], [0.3, 0.2]):
        new = fc.invertible(np.array(theta))
        a, b = np.append(1, theta), np.append(1, new)
        np.testing.assert_allclose(np.correlate(a, a, "full") / (a @ a), np.correlate(b, b, "full") / (b @ b), atol=1e-9)
        assert (abs(np.roots(b)) <= 1 + 1e-9).all()
