"""Global ranks beyond one bucket, singular VIF, symmetric-tree models, named CSV columns."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import regress, splits, stats
from panelforge.operators.ranges import SortKey, row_positions

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_are_exact(spark, partitions):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(partitions)
    got = splits.global_rank(li, ["l_shipdate"], "pos")  # heavy ties
    n = li.count()
    r = got.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(r) == (n, n, 0, n - 1)
    later = got.select("pos", "l_shipdate").groupBy("l_shipdate").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("l_shipdate").collect()
    assert all(x["b"] < y["a"] for x, y in zip(later, later[1:]))


def test_five_folds(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    sizes = [r["count"] for r in splits.kfold_contiguous(li, ["l_orderkey", "l_linenumber"], 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_positions_with_nulls_and_descending(spark):
    rows = [(i, None if i % 3 == 0 else i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, v int")
    got = {r["i"]: r["position"] for r in row_positions(df, [SortKey("v", False), SortKey("i")], n_buckets=16).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[i] for i, _ in want] == list(range(200))


def test_vif_of_tied_and_constant_columns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    cov = np.cov(np.column_stack([x, x[:, 0], np.full(300, 3.0)]), rowvar=False)
    got = dict(stats.vif_from_cov(cov, list("abcd")))
    assert got["a"] == got["c"] == math.inf and got["d"] is None
    r = np.corrcoef(x, rowvar=False)[0, 1]
    assert got["b"] == pytest.approx(1 / (1 - r * r), rel=1e-6)


def test_vif_drop_loop_drops_a_duplicate(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), float(a)) for a, b in rng.normal(size=(200, 2))], "a double, b double, c double")
    kept, dropped = stats.vif_drop_loop(df, ["a", "b", "c"])
    assert len(kept) == 2 and "b" in kept and dropped[0][1] == math.inf


def test_symmetric_trees_saved_and_loaded(spark, tmp_path):
    from panelforge.operators.explain import is_tree_model
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7 > 3) + i % 3) for i in range(80)], "x double, z double, y double")
    model = regress.fit_oblivious(df, ["x", "z"], "y", iterations=4, depth=2)
    regress.save_fitted(regress.Fitted("CatBoost", {"depth": 2}, model, ["x", "z"]), str(tmp_path / "m"))
    back = regress.load_fitted(spark, str(tmp_path / "m"))
    a, b = (sorted(m.transform(df).select("x", "z", "prediction").collect()) for m in (model, back.model))
    assert a == b and is_tree_model(back)


def test_long_csv_by_name(spark, tmp_path):
    from panelforge.sources import files
    (tmp_path / "x.csv").write_text("measure,val,year,location_name,cause_name,upper,lower\nd,1.5,2001,Aland,All causes,2,1\nd,0.5,2001,Aland,A,2,1\n")
    dim = spark.createDataFrame([("Aland", "ALA")], "name string, Code string")
    rows = files.scan_csv_long(spark, str(tmp_path / "x.csv"), dim).collect()
    assert [(r["Code"], r["Year"], r["A"]) for r in rows] == [("ALA", 2001, 0.5)]
    (tmp_path / "y.csv").write_text("measure,val\nd,1\n")
    with pytest.raises(KeyError):
        files.scan_csv_long(spark, str(tmp_path / "y.csv"), dim)
