"""Grids whose fits are dealt out over tasks: the same models as the distributed fits, every cell and tree."""

import inspect
import json

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from panelforge.operators import dealt, options, svr, trees
from panelforge.operators import regress as rg
from panelforge.plans import queries_models as qm

COLS = ["a", "b", "c"]


def _rows(n=90, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    return x, (30 * x[:, 0] - 20 * np.sin(2 * x[:, 1]) + rng.normal(size=n)).round(2)


def _frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))],
                                 "i int, a double, b double, c double, y double, fold int")


def _held(x, y):
    return dealt.Held(x, np.zeros(x.shape, bool), y, np.arange(len(y)) % 3)


def test_option_run_takes_the_whole_reference_grids(monkeypatch):
    class Called(Exception):
        pass

    def run(*args, **named):
        raise Called(inspect.signature(options.run_option).bind(*args, **named))

    monkeypatch.setattr(qm, "run_option", run)
    monkeypatch.setattr(qm.panels, "nation_year_panel", lambda spark, d: None)
    with pytest.raises(Called) as called:
        qm.q_option_run(None, "")
    called.value.args[0].apply_defaults()
    given = called.value.args[0].arguments
    grids = given["grids"] or rg.PARAM_GRIDS
    assert [len(rg.grid_cells(grids[m])) for m in given["models"]] == [6, 6, 24, 72, 48, 36]
    assert grids == rg.PARAM_GRIDS and given["n_folds"] == 5


def test_a_run_of_several_families_begins_its_plans_anew(spark, monkeypatch):
    plans, rows = {}, [(c, t, float(c + t * t), float(c), float(t)) for c in range(8) for t in range(4)]
    panel = spark.createDataFrame(rows, "Code int, Year int, target double, a double, b double").coalesce(1)

    def search(name, grid, train, folds, features, label, *_, old=rg.grid_search):
        plans[name] = [df._jdf.queryExecution().optimizedPlan().toString().count("Join") for df in (train, folds)]
        return old(name, grid, train, folds, features, label, *_)

    monkeypatch.setattr(options.rg, "grid_search", search)
    grids = {m: {"alpha": [0.1, 10]} for m in ("Ridge", "Lasso")}
    pred, scores, _ = options.run_option(panel, ["a", "b"], "target", "geographical", ("Ridge", "Lasso"), grids, n_folds=2)
    assert plans == {"Ridge": [0, 0], "Lasso": [0, 0]}
    alone = options.run_option(panel, ["a", "b"], "target", "geographical", ("Lasso",), grids, n_folds=2)
    got, want = ([(r["Split"], r["Code"], r["Year"], r["predicted"]) for r in p.filter("Model = 'Lasso'").orderBy("Split", "Code", "Year").collect()]
                 for p in (pred, alone[0]))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert scores.filter("Model = 'Lasso'").first()["CV_RMSE"] == pytest.approx(alone[1].first()["CV_RMSE"])


def test_boosted_trees_are_those_of_pyspark(spark):
    x, y = _rows()
    df = _frame(spark, x, y)
    for n, depth, rate in ((1, 3, 0.1), (12, 3, 0.3)):
        est = GBTRegressor(featuresCol=rg.FEATURES, labelCol="y", maxIter=n, maxDepth=depth, stepSize=rate, seed=42)
        theirs = est.fit(rg.assemble(df, COLS)).transform(rg.assemble(df, COLS)).orderBy("i")
        ours = dealt.fit("XGBoost", {"n_estimators": n, "max_depth": depth, "learning_rate": rate}, _held(x, y), 42)
        assert ours.predict(x) == pytest.approx([r["prediction"] for r in theirs.collect()])


def test_a_tree_without_draws_is_that_of_pyspark(spark):
    x, y = _rows(200)
    x[:, 2] = np.arange(200) % 4  # fewer values than bins
    df = rg.assemble(_frame(spark, x, y), COLS)
    est = DecisionTreeRegressor(featuresCol=rg.FEATURES, labelCol="y", maxDepth=9, minInstancesPerNode=3)
    cuts = trees.thresholds(x)
    ours = trees.grow(trees.binned(x, cuts), np.array([len(c) for c in cuts]), y, np.ones((1, 200), int), 9, 3, 3, [None]).with_thresholds(cuts)
    assert ours.predict(x) == pytest.approx([r["prediction"] for r in est.fit(df).transform(df).orderBy("i").collect()])


@pytest.mark.parametrize("name, cell", [("Random Forest", {"max_depth": None, "min_samples_split": 5, "max_features": "sqrt"}),
                                        ("XGBoost", {"max_depth": 3, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.6})])
def test_a_longer_fit_begins_with_the_shorter(monkeypatch, name, cell):
    rows = _held(*_rows())
    long = dealt.fit(name, cell | {"n_estimators": 20}, rows, 42)
    shared = dealt.predicted(name, long, rows, [1, 7, 20])
    monkeypatch.setattr(trees, "CELLS", 1500)  # a forest in parts, nodes in blocks
    for n, p in zip((1, 7, 20), shared):
        assert dealt.fit(name, cell | {"n_estimators": n}, rows, 42).predict(rows.x) == pytest.approx(p)


def test_a_forest_draws_rows_and_features():
    x, y = _rows(300)
    model = dealt.fit("Random Forest", {"n_estimators": 200, "max_depth": None, "min_samples_split": 2, "max_features": "sqrt"}, _held(x, y), 42)
    assert len(model.weight) == 200 and model.weight.sum() == pytest.approx(1)
    roots = np.bincount(model.feature[:200], minlength=3)
    assert roots[0] > 100 and roots[1] > 40  # two of three features a node: a third of the trees go without the best one
    test_x, test_y = _rows(300, 6)
    assert np.sqrt(np.mean((model.predict(test_x) - test_y) ** 2)) < 0.4 * test_y.std()


def test_symmetric_trees_are_those_of_the_aggregates(spark):
    x, y = _rows()
    df = _frame(spark, x, y).coalesce(1).withColumn("b", F.when(F.col("i") % 7 > 0, F.col("b"))).withColumn("c", F.lit(2.0))
    ours = dealt.fit("CatBoost", {"iterations": 5, "depth": 3, "learning_rate": 0.2, "l2_leaf_reg": 3}, dealt.held(df, COLS, "y", F.col("fold")), 42)
    theirs = rg.fit_oblivious(df, COLS, "y", 5, 3, 0.2, 3.0)
    assert ours.base == pytest.approx(theirs.base) and len(ours.trees) == 5
    for (splits, values), (cuts, want) in zip(ours.trees, theirs.trees):
        assert [(COLS[f], ours.borders[f][t]) for f, t in splits] == cuts
        assert values == pytest.approx(want)


@pytest.mark.parametrize("kind", ["kfold", "timeseries"])
@pytest.mark.parametrize("name, grid", [("SVR", {"C": [1.0, 10.0], "epsilon": [0.1], "kernel": ["linear", "rbf"]}),
                                        ("CatBoost", {"iterations": [1, 2], "depth": [2], "learning_rate": [0.3], "l2_leaf_reg": [3]})])
def test_a_long_panel_has_the_same_scores(spark, monkeypatch, name, grid, kind):
    from panelforge.operators import splits
    df = _frame(spark, *_rows()).drop("fold").coalesce(1).cache()
    folds = (splits.kfold_contiguous(df, ["i"], 3) if kind == "kfold" else splits.timeseries_cv(df, ["i"], 3)).coalesce(1).cache()
    found = []
    for most in (dealt.TASK_ROWS, 50):
        monkeypatch.setattr(dealt, "TASK_ROWS", most)
        fitted, scores, best, _ = rg.grid_search(name, grid, df, folds, COLS, "y", 3, kind)
        rows = sorted((r["params"], r["fold"], r["rmse"]) for r in scores.collect())
        found.append((fitted.params, [r[:2] for r in rows], [r[2] for r in rows], best, [r["prediction"] for r in fitted.transform(df).orderBy("i").collect()]))
    assert len(found[0][1]) == 3 * len(rg.grid_cells(grid))
    for a, b in zip(*found):
        assert a == (b if isinstance(b, (dict, list)) and not isinstance(b[0] if isinstance(b, list) else None, float) else pytest.approx(b))


def test_every_cell_and_fold_is_scored_and_the_best_refitted(spark):
    x, y = _rows()
    df = _frame(spark, x, y)
    grid = {"n_estimators": [3, 6], "max_depth": [2, None], "min_samples_split": [2, 10], "max_features": [0.5]}
    fitted, scores, best, _ = rg.grid_search("Random Forest", grid, df, df, COLS, "y", 3)
    got = {(r["params"], r["fold"]): r["rmse"] for r in scores.collect()}
    assert len(got) == 24
    rows, want = dealt.held(df, COLS, "y", F.col("fold")), {}
    for c in rg.grid_cells(grid):
        for f in range(3):
            out = rows.only(rows.part == f)
            p = dealt.fit("Random Forest", c, rows.only(rows.part != f), rg.SEED).predict(out.x)
            want[json.dumps(c, sort_keys=True), f] = float(np.sqrt(np.mean((out.y - p) ** 2)))
    assert got == pytest.approx(want)
    mean = {p: np.mean([v for (q, _), v in want.items() if q == p]) for p, _ in want}
    assert best == pytest.approx(min(mean.values())) and json.dumps(fitted.params, sort_keys=True) == min(mean, key=mean.get)


def test_trees_are_saved_and_loaded_and_raise_on_a_null(spark, tmp_path):
    from panelforge.operators.explain import is_tree_model
    x, y = _rows()
    df = _frame(spark, x, y)
    fitted, *_ = rg.grid_search("XGBoost", {"n_estimators": [2, 4], "max_depth": [2], "learning_rate": [0.1]}, df, df, COLS, "y", 3)
    rg.save_fitted(fitted, str(tmp_path / "m"))
    back = rg.load_fitted(spark, str(tmp_path / "m"))
    a, b = ([r["prediction"] for r in m.transform(df).orderBy("i").collect()] for m in (fitted, back))
    assert a == b and is_tree_model(back) and fitted.transform(df).columns == [*df.columns, "prediction"]
    odd = df.withColumn("b", F.when(F.col("i") > 0, F.col("b")))
    with pytest.raises(Exception, match="NULL or NaN"):
        back.transform(odd).collect()
    with pytest.raises(Exception, match="NULL or NaN"):
        rg.grid_search("XGBoost", {"n_estimators": [2, 4], "max_depth": [2], "learning_rate": [0.1]}, odd, odd, COLS, "y", 3)


def test_many_symmetric_trees_are_looped_over(spark, monkeypatch):
    x, y = _rows()
    df = _frame(spark, x, y).withColumn("a", F.when(F.col("i") % 5 > 0, F.col("a"))).withColumn("b", F.when(F.col("i") == 3, float("nan")).otherwise(F.col("b")))
    trees_ = [([("a", 0.1), ("b", -0.2)], [1.0, 2.0, 4.0, 8.25]), ([("c", 0.3)], [-1.5, 1e-7])]
    model = rg.ObliviousBoostModel(COLS, 3.5, trees_)
    inline = [r["prediction"] for r in model.transform(df).orderBy("i").collect()]
    monkeypatch.setattr(rg, "MAX_INLINE_TREES", 0)
    assert [r["prediction"] for r in model.transform(df).orderBy("i").collect()] == inline


def test_svr_at_hand_is_svr_by_passes(spark):
    x, y = _rows()
    fit = [svr.Fit(lambda part: part != 1, 10.0, 0.1, "rbf"), svr.Fit(lambda part: part != 2, 1.0, 0.5, "linear")]
    with svr.Rows(_frame(spark, x, y), COLS, "y", F.col("fold")) as rows:
        want = rows.fit(fit, 20, 500, 1e-3, 42)
    for a, b in zip(svr.Held(x, y, np.arange(len(y)) % 3).fit(fit, 20, 500, 1e-3, 42), want):
        assert a.w == pytest.approx(b.w, rel=1e-4, abs=1e-6) and a.b == pytest.approx(b.b, rel=1e-4)


def test_random_fourier_features_are_scored_as_fitted(spark):
    x, y = _rows()
    df = _frame(spark, x, y)
    model = rg.fit_svr(df, COLS, "y", 10.0, 0.1, "rbf", n_components=100, max_iter=500)
    line = svr.Line(model.w, model.b, model.rff)
    got = [r["prediction"] for r in model.transform(df).orderBy("i").collect()]
    assert got == pytest.approx((line.inputs(x) @ np.append(model.w, model.b)).tolist())
    null = df.limit(1).withColumn("b", F.lit(None).cast("double"))
    assert model.transform(null).first()["prediction"] is None
