"""DuckDB SQL twins of the panel builders in :mod:`panels` (oracle side)."""

P1_CTE = """
li AS (
  SELECT l_orderkey, count(*) AS li_n, sum(l_quantity) AS li_qty,
         sum(l_discount) AS li_disc, sum(l_tax) AS li_tax, sum(l_extendedprice) AS li_price
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         c.c_nationkey, c.c_acctbal, li.li_n, li.li_qty, li.li_disc, li.li_tax, li.li_price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
agg AS (
  SELECT c_nationkey AS Code, CAST(year(o_orderdate) AS INTEGER) AS Year,
         avg(o_totalprice) AS target, count(*) AS n_orders, avg(c_acctbal) AS acctbal_mean,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS urgent_share,
         sum(li_qty) / sum(li_n) AS qty_mean, sum(li_disc) / sum(li_n) AS discount_mean,
         sum(li_tax) / sum(li_n) AS tax_mean, sum(li_price) / sum(li_n) AS price_mean
  FROM facts GROUP BY 1, 2),
dim AS (
  SELECT n_nationkey AS Code, n_name AS Country, r_name AS Region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
p1 AS (
  SELECT d.Country, a.Code, d.Region, a.Year, a.target, a.n_orders, a.acctbal_mean,
         a.urgent_share, a.qty_mean, a.discount_mean, a.tax_mean, a.price_mean
  FROM agg a LEFT JOIN dim d ON a.Code = d.Code),
p1g AS (
  SELECT * REPLACE (CASE WHEN (Code + Year) % 4 = 0 OR (Year <= 1996 AND Code % 3 = 0)
                         THEN NULL ELSE target END AS target) FROM p1)
"""

P1_PRED = ["n_orders", "acctbal_mean", "urgent_share", "qty_mean", "discount_mean",
           "tax_mean", "price_mean"]
P1_DOUBLES = ["target", "acctbal_mean", "urgent_share", "qty_mean", "discount_mean",
              "tax_mean", "price_mean"]

P2_CTE = """
p2 AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         avg(value) FILTER (WHERE event_type = 'view') AS "view",
         avg(value) FILTER (WHERE event_type = 'signup') AS signup,
         avg(value) FILTER (WHERE event_type = 'error') AS error,
         avg(value) FILTER (WHERE event_type = 'click') AS click,
         avg(value) FILTER (WHERE event_type = 'purchase') AS purchase
  FROM events GROUP BY 1, 2)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

SPLIT_CTE = """
yr AS (SELECT Year, row_number() OVER (ORDER BY Year) - 1 AS pos, count(*) OVER () AS n
       FROM (SELECT DISTINCT Year FROM p1 WHERE Year IS NOT NULL)),
ysplit AS (SELECT Year, CASE WHEN pos < floor(n * CAST(0.70 AS DOUBLE)) THEN 'train'
                             WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'test'
                             ELSE 'val' END AS split FROM yr),
ps AS (SELECT p1.*, ysplit.split FROM p1 LEFT JOIN ysplit USING (Year)),
pl AS (SELECT *, lag(target) OVER (PARTITION BY Code ORDER BY Year) AS _lag,
              avg(CASE WHEN split = 'train' THEN target END) OVER (PARTITION BY Code) AS _tm FROM ps),
pred AS (
  SELECT 'lag1' AS Model, CASE WHEN split = 'test' THEN 'Test' ELSE 'Val' END AS Split,
         Code, Country, Region, Year, target AS actual, _lag AS predicted
  FROM pl WHERE split <> 'train' AND _lag IS NOT NULL
  UNION ALL
  SELECT 'train_mean', CASE WHEN split = 'test' THEN 'Test' ELSE 'Val' END,
         Code, Country, Region, Year, target, _tm
  FROM pl WHERE split <> 'train' AND _tm IS NOT NULL)
"""

P4_CTE = """
p4 AS (
  SELECT c_nationkey AS Code, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS Period,
         avg(o_totalprice) AS target, count(*) AS n_orders,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS urgent_share,
         sum(li_qty) / sum(li_n) AS qty_mean
  FROM facts GROUP BY 1, 2),
pyr AS (SELECT Period, row_number() OVER (ORDER BY Period) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT DISTINCT Period FROM p4)),
p4s AS (SELECT p4.*, CASE WHEN pos < floor(n * CAST(0.70 AS DOUBLE)) THEN 'train'
                          WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'test' ELSE 'val' END AS split
        FROM p4 JOIN pyr USING (Period))
"""

P3_CTE = """
p3 AS (
  SELECT o_custkey AS Code, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS Period,
         c_nationkey AS "Group",
         avg(o_totalprice) AS target, count(*) AS n_orders, avg(c_acctbal) AS acctbal_mean,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS urgent_share,
         sum(li_qty) / sum(li_n) AS qty_mean, sum(li_disc) / sum(li_n) AS discount_mean,
         sum(li_tax) / sum(li_n) AS tax_mean, sum(li_price) / sum(li_n) AS price_mean
  FROM facts GROUP BY 1, 2, 3)
"""
