"""Ridge and Lasso from moments against closed forms and optimality conditions on the rows."""
import numpy as np
import pytest

from panelforge.operators import moments as mo
from panelforge.operators import regress as rg
from panelforge.operators import splits as spl


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4)) * [1, 5, 0.1, 2] + [1e6, -3, 0, 50]
    y = x @ [2.0, 0.0, -30.0, 1.0] + rng.normal(size=120)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, d double, y double")
    return x, y, df


COLS = ["a", "b", "c", "d"]


def closed_ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - w @ x.mean(0)


def test_ridge_and_error(data):
    x, y, df = data
    m = mo.moments_by(df, COLS, "y")[None]
    for alpha in (0.01, 10.0):
        w, b = mo.ridge(m, alpha)
        want = closed_ridge(x, y, alpha)
        np.testing.assert_allclose(w, want[0], rtol=1e-8)
        np.testing.assert_allclose(b, want[1], rtol=1e-8)
        np.testing.assert_allclose(m.squared_error(w, b), ((y - b - x @ w) ** 2).sum(), rtol=1e-6)


def test_lasso_meets_its_conditions(data):
    x, y, df = data
    m = mo.moments_by(df, COLS, "y")[None]
    for alpha in (0.01, 0.5, 100.0):
        w, b = mo.lasso(m, alpha)
        slope = (x - x.mean(0)).T @ (y - b - x @ w) / len(y)
        for j in range(4):
            assert abs(slope[j]) <= alpha + 1e-6
            if w[j]:
                assert abs(slope[j] - alpha * np.sign(w[j])) < 1e-6
    assert not w.any()


@pytest.mark.parametrize("kind", ["kfold", "timeseries"])
@pytest.mark.parametrize("name", ["Ridge", "Lasso"])
def test_grid_equals_fits_on_the_rows(spark, data, kind, name):
    x, y, df = data
    folds = (spl.kfold_contiguous if kind == "kfold" else spl.timeseries_cv)(df, ["i"], 5)
    fitted, scores, best, _ = rg.grid_search(name, {"alpha": [0.1, 1, 100]}, df, folds, COLS, "y", 5, kind)
    got = {(r["params"], r["fold"]): r["rmse"] for r in scores.collect()}
    assert len(got) == 15
    for f, tr, te in rg.cv_pairs(df, folds, 5, kind):
        for alpha in (0.1, 1, 100):
            one = rg.fit_model(name, {"alpha": alpha}, tr, COLS, "y")
            assert abs(rg.rmse_of(one, te, "y") - got[f'{{"alpha": {alpha}}}', f]) < 1e-5
    means = {p: np.mean([v for (q, _), v in got.items() if q == p]) for p, _ in got}
    assert abs(best - min(means.values())) < 1e-9 and f'"alpha": {fitted.params["alpha"]}' in min(means, key=means.get)
    again = rg.fit_model(name, fitted.params, df, COLS, "y")
    np.testing.assert_allclose(fitted.model.w, again.model.w, rtol=1e-6, atol=1e-9)


def test_saved_and_loaded(spark, data, tmp_path):
    _, _, df = data
    m = rg.fit_model("Ridge", {"alpha": 1}, df, COLS, "y")
    rg.save_fitted(m, str(tmp_path / "m"))
    back = rg.load_fitted(spark, str(tmp_path / "m"))
    assert [r[0] for r in back.transform(df).select("prediction").collect()] == [r[0] for r in m.transform(df).select("prediction").collect()]


def test_missing_values_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, y double")
    with pytest.raises(ValueError, match="1 rows have a NULL"):
        mo.moments_by(df, ["a"], "y")
    with pytest.raises(ValueError, match="no rows"):
        rg.fit_model("Ridge", {"alpha": 1}, df.limit(0), ["a"], "y")
