"""SVR: one pass over the rows serves all folds; small frames are read by few tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import regress as rg
from panelforge.operators import splits, svr
from panelforge.session import sized


@pytest.mark.parametrize("kind, kernel", [("kfold", "linear"), ("timeseries", "linear"), ("kfold", "rbf")])
def test_a_grid_of_svr_is_its_single_fits(spark, monkeypatch, kind, kernel):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 2))
    rows = [(i, *map(float, v), float(40 * v[0] - 7 * v[1] + e)) for i, (v, e) in enumerate(zip(x, rng.normal(size=90)))]
    df = spark.createDataFrame(rows, "i int, a double, b double, y double").repartition(8)
    folds = splits.kfold_contiguous(df, ["i"], 3) if kind == "kfold" else splits.timeseries_cv(df, ["i"], 3)
    passes = []
    monkeypatch.setattr(svr.Rows, "sums", lambda self, requests, old=svr.Rows.sums: (passes.append(len(requests)), old(self, requests))[1])
    grid = {"C": [10.0], "epsilon": [0.1], "kernel": [kernel]}
    fitted, scores, best, _ = rg.grid_search("SVR", grid, df, folds, ["a", "b"], "y", 3, kind)
    assert passes[0] == 4  # three folds and the refit
    single, found = rg.fit_model("SVR", {"C": 10.0, "epsilon": 0.1, "kernel": kernel}, df, ["a", "b"], "y"), []
    assert np.allclose(fitted.model.w, single.model.w) and fitted.model.b == pytest.approx(single.model.b)
    for f, train, test in rg.cv_pairs(df, folds.cache(), 3, kind):
        found.append(rg.rmse_of(rg.fit_model("SVR", {"C": 10.0, "kernel": kernel}, train, ["a", "b"], "y"), test, "y"))
    assert [r["rmse"] for r in scores.orderBy("fold").collect()] == pytest.approx(found)
    assert best == pytest.approx(np.mean(found))


def test_more_fits_than_one_pass_holds(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") / 10).alias("x"), (F.col("id") * 3.0).alias("y"), (F.col("id") % 3).alias("fold"))
    grid = {"C": [1.0, 100.0], "epsilon": [0.1, 5.0], "kernel": ["linear"]}
    whole = rg.grid_search("SVR", grid, df, df, ["x"], "y", 3)
    monkeypatch.setattr(svr, "PASS_NUMBERS", 9)
    parted = rg.grid_search("SVR", grid, df, df, ["x"], "y", 3)
    assert sorted(whole[1].collect()) == sorted(parted[1].collect()) and whole[0].params == parted[0].params


def test_svr_raises_on_a_missing_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, 5.0)], "x double, y double")
    with pytest.raises(RuntimeError):
        rg.fit_svr(df, ["x"], "y")


def test_sized_keeps_rows_in_few_partitions(spark):
    df = spark.range(1000).repartition(20)
    small, held = sized(df, 400)
    assert small.select(F.spark_partition_id()).distinct().count() == 3
    assert small.agg(F.sum("id")).first()[0] == 499500
    assert sized(df, 10)[0].select(F.spark_partition_id()).distinct().count() == 20
    held.unpersist()
