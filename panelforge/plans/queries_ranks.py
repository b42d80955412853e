"""Global ranks and folds at row grain (orders, lineitem), with payload columns:
the panel queries alone never outgrow one bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import splits
from panelforge.plans.registry import query


@query("rank_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus,
  row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderkey) - 1 AS pos FROM orders""")
def q_rank_orders(spark, d):
    """ORD1 on every order: date, price, key."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return splits.global_rank(o, ["o_orderdate", "o_totalprice", "o_orderkey"], "pos").select("o_orderkey", "o_custkey", "o_orderstatus", "pos")


@query("kfold_lineitem", """
WITH n AS (SELECT count(*) AS n FROM lineitem),
pos AS (SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS pos FROM lineitem),
f AS (SELECT l_quantity, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
  ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM pos, n)
SELECT fold::INTEGER AS fold, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity FROM f GROUP BY fold""")
def q_kfold_lineitem(spark, d):
    """WIN7 on every lineitem row: size and content of each fold."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    folds = splits.kfold_contiguous(li, ["l_orderkey", "l_linenumber", "l_quantity"], 5)
    return folds.groupBy("fold").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("timeseries_cv_orders", """
WITH n AS (SELECT count(*) AS n, count(*) // 6 AS t FROM orders),
pos AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
f AS (SELECT fold, CASE WHEN pos < n - 5 * t + fold * t THEN 'train' WHEN pos < n - 5 * t + fold * t + t THEN 'test' END AS role
  FROM pos, n, (VALUES (0), (1), (2), (3), (4)) k(fold))
SELECT fold, role, count(*) AS n_rows FROM f WHERE role IS NOT NULL GROUP BY ALL""")
def q_timeseries_cv_orders(spark, d):
    """WIN8 on every order: fold sizes."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    return splits.timeseries_cv(o, ["o_orderdate", "o_orderkey"], 5).groupBy("fold", "role").agg(F.count("*").alias("n_rows"))
