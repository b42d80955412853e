"""Registered queries: panel build, scans, projections, filters, joins,
reshape, set operations, ordering, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import relational as rel
from panelforge.operators import reshape
from panelforge.operators import stats
from panelforge.plans import panels
from panelforge.plans.panels import P1_PREDICTORS, table
from panelforge.plans.registry import R, query, rnd
from panelforge.plans.sql_panels import P1_CTE, P1_DOUBLES, P2_CTE, with_
from panelforge.session import Panel

P1_COLS = ["Country", "Code", "Region", "Year", "target", *P1_PREDICTORS]


@query("panel_nation_year",
       R(with_(P1_CTE) + "SELECT * FROM p1", P1_DOUBLES))
def q_panel(spark, d):
    """SRC2 + JN2 + AGG: the P1 panel itself (flagship build)."""
    return rnd(panels.nation_year_panel(spark, d))


@query("trend_by_group",
       R(with_(P1_CTE) + """
SELECT Region, Year, avg(target) AS mean_target, count(*) AS n_entities
FROM p1 GROUP BY Region, Year""", ["mean_target"]))
def q_trend_by_group(spark, d):
    """AGG4 / CH2: mean target per (group, period)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(stats.trend_by_group(p, "Year", "Region", "target"))


# ------------------------------------------------------------------- sources
@query("scan_parquet", R("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'""", ["l_quantity", "l_extendedprice"]))
def q_scan_parquet(spark, d):
    """SRC2: projection + predicates reach the Parquet scan (ReadSchema of
    5 columns, PushedFilters on l_shipdate / l_returnflag)."""
    from panelforge.sources.files import scan_parquet
    df = scan_parquet(spark, f"{d}/lineitem.parquet",
                      ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
                      (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
                      & (F.col("l_returnflag") == "R"))
    return rnd(df)


def _long_measures(spark, d):
    """Long measure table (location_name, year, cause_name, val) derived
    from P1, plus an 'All causes' total row per (name, year)."""
    p = panels.nation_year_panel(spark, d)
    long = p.select(F.col("Country").alias("location_name"), F.col("Year").alias("year"),
                    F.stack(F.lit(3), F.lit("acctbal_mean"), "acctbal_mean", F.lit("qty_mean"), "qty_mean",
                            F.lit("All causes"), F.col("acctbal_mean") + F.col("qty_mean"))
                    .alias("cause_name", "val"))
    return long


@query("scan_csv_long", R(with_(P1_CTE) + """
SELECT Country, Code, Year, acctbal_mean, qty_mean FROM p1 WHERE Year >= 1996""",
                          ["acctbal_mean", "qty_mean"]))
def q_scan_csv_long(spark, d):
    """SRC1 + JN13 + RSH1 + FLT1 + PRJ3: a long CSV written by Spark from the
    tables, read back with an explicit schema, names mapped to codes by a
    dimension join, pivoted wide (duplicate check), 'All causes' dropped,
    years filtered."""
    from panelforge.session import scratch_path
    from panelforge.sources.files import scan_csv_long
    path = scratch_path(spark, "long_csv")
    _long_measures(spark, d).write.mode("overwrite").option("header", True).csv(path)
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"),
                                            F.col("n_nationkey").alias("Code"))
    wide = scan_csv_long(spark, path, names, min_year=1996,
                         categories=["All causes", "acctbal_mean", "qty_mean"])
    return rnd(wide.select("Country", "Code", "Year", "acctbal_mean", "qty_mean"))


@query("scan_by_extension", R(with_(P1_CTE) + """
SELECT 'parquet' AS fmt, * FROM p1 UNION ALL SELECT 'csv' AS fmt, * FROM p1""", P1_DOUBLES))
def q_scan_by_extension(spark, d):
    """SRC3 + SNK1 + SNK2: write P1 by suffix (.parquet / .csv), read both
    back by suffix (CSV with the panel's explicit schema)."""
    from panelforge.session import scratch_path
    from panelforge.sources.files import load_table, save_table
    p = panels.nation_year_panel(spark, d)
    base = scratch_path(spark, "by_ext")
    a = load_table(spark, save_table(p, base + ".parquet"))
    b = load_table(spark, save_table(p, base + ".csv"), csv_schema=p.schema)
    return rnd(a.withColumn("fmt", F.lit("parquet")).unionByName(b.withColumn("fmt", F.lit("csv"))))


def _indicator_pages(spark, d):
    """Indicator payload pages derived from ``events``: records grouped
    into pages of at most 50 (event_id div 50), each page a JSON document
    ``[paging, [records]]``; a record carries a nested country struct, a
    lower-case code, a string date and the value from ``props``."""
    ev = table(spark, d, "events")
    rec = F.struct(F.struct(F.col("event_type").alias("value")).alias("country"),
                   F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("countryiso3code"),
                   F.dayofmonth("ts").cast("string").alias("date"),
                   F.get_json_object("props", "$.k").cast("double").alias("value"))
    pages = ev.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(
        F.collect_list(rec).alias("recs"), F.count(F.lit(1)).alias("n"))
    paging = F.to_json(F.struct(F.col("page"), F.col("n").alias("per_page")))
    return pages.select(F.concat(F.lit("["), paging, F.lit(","), F.to_json("recs"), F.lit("]"))
                        .alias("payload"))


@query("ingest_indicator_json", """
SELECT event_type AS Country, upper('u' || CAST(user_id AS VARCHAR)) AS Code,
       CAST(day(ts) AS INTEGER) AS Year, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_value
FROM events
WHERE upper('u' || CAST(user_id AS VARCHAR)) IN
      (SELECT upper('u' || CAST(user_id AS VARCHAR)) FROM events WHERE event_type = 'purchase')""")
def q_ingest_indicator(spark, d):
    """SRC4 (+SRC7): parse indicator pages (element [1] -> array<struct>),
    nested field, upper-case code, date -> int, drop NULLs, keep the listed
    entities (semi join with the users that purchased)."""
    from panelforge.sources.ingest import ingest_indicator
    ents = (table(spark, d, "events").filter(F.col("event_type") == "purchase")
            .select(F.upper(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("Code")))
    return ingest_indicator(_indicator_pages(spark, d), "k_value", ents)


def _odata_pages(spark, d):
    """OData pages from ``lineitem``: one page per 25 order keys, records
    (SpatialDim, TimeDim, Dim1, Dim2, NumericValue)."""
    li = table(spark, d, "lineitem")
    rec = F.struct(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("SpatialDim"),
        F.year("l_shipdate").alias("TimeDim"),
        F.when(F.col("l_returnflag") == "N", "SEX_BTSX").otherwise("SEX_MLE").alias("Dim1"),
        F.when(F.col("l_linestatus") == "O", "AGEGROUP_YEARSALL")
        .otherwise("AGEGROUP_YEARS15-24").alias("Dim2"),
        F.col("l_extendedprice").alias("NumericValue"))
    pages = li.groupBy(F.floor(F.col("l_orderkey") / 25).alias("page")).agg(
        F.collect_list(rec).alias("value"))
    return pages.select(F.to_json(F.struct("value")).alias("payload"))


@query("ingest_odata_json", R("""
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS Code, CAST(year(l_shipdate) AS INTEGER) AS Year,
       l_extendedprice AS target
FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'""", ["target"]))
def q_ingest_odata(spark, d):
    """SRC5: explode value[], two-dimension filter, rename; raises when empty."""
    from panelforge.sources.ingest import ingest_odata
    return rnd(ingest_odata(_odata_pages(spark, d), "target"))


# Example configuration dimension (region -> macro area);
# one region deliberately unmapped.
MACRO_AREA = {"AFRICA": "EMEA", "EUROPE": "EMEA", "MIDDLE EAST": "EMEA", "AMERICA": "AMER"}


@query("map_label", R(with_(P1_CTE) + """
SELECT p1.*, m.Area FROM p1 LEFT JOIN (VALUES ('AFRICA','EMEA'), ('EUROPE','EMEA'),
  ('MIDDLE EAST','EMEA'), ('AMERICA','AMER')) m(Region, Area) USING (Region)""", P1_DOUBLES))
def q_map_label(spark, d):
    """PRJ5 + SRC6 + JN3: configuration dictionary as a broadcast dimension
    (known row count), left join, unmapped -> NULL."""
    dim = spark.createDataFrame(list(MACRO_AREA.items()), "Region string, Area string")
    p = panels.nation_year_panel(spark, d)
    return rnd(rel.lookup_join(p, dim, "Region", "left", known_rows=len(MACRO_AREA)))


# ---------------------------------------------------------------- projections
@query("project_rename", R(with_(P1_CTE) + """
SELECT Code AS entity, Year AS period, target AS y FROM p1""", ["y"]))
def q_project_rename(spark, d):
    """PRJ1: column subset + rename."""
    p = panels.nation_year_panel(spark, d).select("Code", "Year", "target")
    return rnd(p.withColumnsRenamed({"Code": "entity", "Year": "period", "target": "y"}))


@query("predictor_list", R(with_(P1_CTE) + """
SELECT n_orders, acctbal_mean, urgent_share, discount_mean, tax_mean, price_mean FROM p1""",
                           ["acctbal_mean", "urgent_share", "discount_mean", "tax_mean", "price_mean"]))
def q_predictor_list(spark, d):
    """PRJ2: the columns without a role in the panel, less one left out, in schema order."""
    p = panels.nation_year_panel(spark, d)
    cols = rel.predictor_list(p, Panel(), leave_out=["qty_mean"])
    return rnd(p.select(*cols))


@query("drop_columns", R(with_(P1_CTE) + """
SELECT Country, Code, Region, Year, target, n_orders, acctbal_mean, urgent_share, qty_mean
FROM p1""", ["target", "acctbal_mean", "urgent_share", "qty_mean"]))
def q_drop_columns(spark, d):
    """PRJ3: lenient drop (an absent name is ignored)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(rel.drop_columns(p, ["discount_mean", "tax_mean", "price_mean", "not_there"]))


@query("unit_rescale", R(with_(P1_CTE) + """
SELECT Code, Year, urgent_share * 100 AS urgent_pct FROM p1""", ["urgent_pct"]))
def q_unit_rescale(spark, d):
    """PRJ4: x100 rescale into a new column, source dropped, only if present."""
    from panelforge.sources.ingest import unit_rescale
    p = panels.nation_year_panel(spark, d).select("Code", "Year", "urgent_share")
    return rnd(unit_rescale(unit_rescale(p, "urgent_share", "urgent_pct"), "absent", "x"))


@query("literal_tag", R(with_(P1_CTE) + """
SELECT Code, Year, target, 'Actual' AS Series, 'B' AS Option,
       'Cluster ' || CAST(Code % 4 AS VARCHAR) AS Cluster FROM p1""", ["target"]))
def q_literal_tag(spark, d):
    """PRJ6 + PRJ7: constant tag columns and a formatted label."""
    from panelforge.functions.exprs import cluster_label
    p = panels.nation_year_panel(spark, d).select("Code", "Year", "target")
    p = rel.literal_tag(p, Series="Actual", Option="B")
    return rnd(p.withColumn("Cluster", cluster_label(F.col("Code") % 4)))


@query("numeric_columns", R(with_(P1_CTE) + f"""
SELECT Code, Year, target, {', '.join(P1_PREDICTORS)} FROM p1""", P1_DOUBLES))
def q_numeric_columns(spark, d):
    """PRJ8: numeric columns only (the period column included)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(p.select(*rel.numeric_columns(p)))


@query("round_cols", with_(P1_CTE) + """
SELECT Code, Year, round(target, 2) AS target_2, round(urgent_share, 3) AS urgent_3,
       round(qty_mean, 4) AS qty_4 FROM p1""")
def q_round_cols(spark, d):
    """PRJ11: rounding to 2 / 3 / 4 places."""
    p = panels.nation_year_panel(spark, d)
    return p.select("Code", "Year", F.round("target", 2).alias("target_2"),
                    F.round("urgent_share", 3).alias("urgent_3"), F.round("qty_mean", 4).alias("qty_4"))


# -------------------------------------------------------------------- filters
@query("filter_compare", R(with_(P1_CTE) + """
SELECT * FROM p1 WHERE Year >= 1997 AND Region = 'EUROPE'""", P1_DOUBLES))
def q_filter_compare(spark, d):
    """FLT1: comparison filters (period >= x, group == y)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(p.filter((F.col("Year") >= 1997) & (F.col("Region") == "EUROPE")))


@query("filter_conjunction", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
WHERE l_discount >= 0.05 AND l_quantity < 10 GROUP BY 1, 2""")
def q_filter_conjunction(spark, d):
    """FLT2: two-predicate AND, pushed into the scan."""
    li = table(spark, d, "lineitem")
    return (li.filter((F.col("l_discount") >= 0.05) & (F.col("l_quantity") < 10))
            .groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))


@query("filter_isin", R(with_(P1_CTE) + """
SELECT * FROM p1 WHERE Code IN (1, 3, 5, 7, 11, 13)""", P1_DOUBLES))
def q_filter_isin(spark, d):
    """FLT3: membership in a short configured list (``isin``)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(p.filter(F.col("Code").isin([1, 3, 5, 7, 11, 13])))


@query("cutoff_partition", R(with_(P1_CTE) + """
SELECT *, CASE WHEN Year <= 1999 THEN 'labeled' ELSE 'unlabeled' END AS part FROM p1""", P1_DOUBLES))
def q_cutoff_partition(spark, d):
    """FLT4: labeled (<= cutoff) / unlabeled (> cutoff) from one lineage."""
    p = panels.nation_year_panel(spark, d)
    a, b = rel.cutoff_partition(p, "Year", 1999)
    return rnd(a.withColumn("part", F.lit("labeled")).unionByName(b.withColumn("part", F.lit("unlabeled"))))


@query("drop_nulls", R(with_(P1_CTE) + "SELECT * FROM p1g WHERE target IS NOT NULL", P1_DOUBLES))
def q_drop_nulls(spark, d):
    """FLT5: listwise deletion on a subset of columns."""
    return rnd(panels.nation_year_panel_gaps(spark, d).dropna(subset=["target"]))


@query("null_profile", with_(P2_CTE) + """
SELECT * FROM (
  SELECT 'view' AS "column", count(*) - count("view") AS n_null FROM p2 UNION ALL
  SELECT 'signup', count(*) - count(signup) FROM p2 UNION ALL
  SELECT 'error', count(*) - count(error) FROM p2 UNION ALL
  SELECT 'click', count(*) - count(click) FROM p2 UNION ALL
  SELECT 'purchase', count(*) - count(purchase) FROM p2) WHERE n_null > 0""")
def q_null_profile(spark, d):
    """FLT6: NULL count per column in one aggregate pass (user-day panel)."""
    p = panels.user_day_panel(spark, d)
    return rel.null_profile(p, panels.EVENT_TYPES)


@query("rows_with_nulls", with_(P2_CTE) + """
SELECT user_id, CAST(day AS VARCHAR) AS day FROM p2 WHERE "view" IS NULL OR signup IS NULL OR error IS NULL
  OR click IS NULL OR purchase IS NULL""")
def q_rows_with_nulls(spark, d):
    """FLT6: rows with a NULL in any listed column."""
    p = panels.user_day_panel(spark, d)
    return rel.rows_with_nulls(p, panels.EVENT_TYPES).select(
        "user_id", F.col("day").cast("string").alias("day"))


@query("required_columns", R(with_(P1_CTE) + """
SELECT price_mean, qty_mean, n_orders FROM p1""", ["price_mean", "qty_mean"]))
def q_required_columns(spark, d):
    """FLT7: validate required columns, then order them as fitted."""
    p = panels.nation_year_panel(spark, d)
    order = ["price_mean", "qty_mean", "n_orders"]
    return rnd(rel.require_columns(p, order).select(*order))


# ---------------------------------------------------------------------- joins
@query("join_left_equi_multi", with_(P1_CTE) + """
, f AS (SELECT c_nationkey AS Code, CAST(year(o_orderdate) AS INTEGER) AS Year, o_orderstatus
        FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT p1.Code, p1.Year, a.n_f, b.n_o, c.n_p FROM p1
LEFT JOIN (SELECT Code, Year, CAST(count(*) AS DOUBLE) AS n_f FROM f WHERE o_orderstatus = 'F' GROUP BY 1, 2) a USING (Code, Year)
LEFT JOIN (SELECT Code, Year, CAST(count(*) AS DOUBLE) AS n_o FROM f WHERE o_orderstatus = 'O' GROUP BY 1, 2) b USING (Code, Year)
LEFT JOIN (SELECT Code, Year, CAST(count(*) AS DOUBLE) AS n_p FROM f WHERE o_orderstatus = 'P' GROUP BY 1, 2) c USING (Code, Year)""")
def q_join_multi(spark, d):
    """JN1: several indicator tables attached on (Code, Year) — as ONE
    union + pivot + left join instead of one join per indicator."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    f = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("Code"), F.year("o_orderdate").alias("Year"), "o_orderstatus")
    inds = [f.filter(F.col("o_orderstatus") == s).groupBy("Code", "Year")
            .agg(F.count(F.lit(1)).cast("double").alias(f"n_{s.lower()}")) for s in "FOP"]
    base = panels.nation_year_panel(spark, d).select("Code", "Year")
    return rel.join_indicators(base, inds)


@query("join_left_target", R(with_(P1_CTE) + """
SELECT p1.Code, p1.Year, p1.n_orders, t.target_f FROM p1 LEFT JOIN (
  SELECT c_nationkey AS Code, CAST(year(o_orderdate) AS INTEGER) AS Year, avg(o_totalprice) AS target_f
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2) t
USING (Code, Year)""", ["target_f"]))
def q_join_left_target(spark, d):
    """JN2: left join of the target table on (Code, Year)."""
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    c = table(spark, d, "customer")
    t = (o.join(c, o.o_custkey == c.c_custkey)
         .groupBy(F.col("c_nationkey").alias("Code"), F.year("o_orderdate").alias("Year"))
         .agg(F.avg("o_totalprice").alias("target_f")))
    base = panels.nation_year_panel(spark, d).select("Code", "Year", "n_orders")
    return rnd(base.join(t, ["Code", "Year"], "left"))


@query("lookup_code", """
SELECT c_custkey, n.n_nationkey AS Code FROM customer c
LEFT JOIN nation n0 ON c.c_nationkey = n0.n_nationkey
LEFT JOIN nation n ON lower(trim(CASE WHEN c.c_acctbal < 0 THEN 'Atlantis' ELSE '  ' || upper(n0.n_name) || ' ' END))
                    = lower(trim(n.n_name))""")
def q_lookup_code(spark, d):
    """JN13: name -> code through a name dimension on lower(trim(name));
    unknown names keep their row with a NULL code."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    raw = (c.join(n, c.c_nationkey == n.n_nationkey, "left")
           .select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit("Atlantis"))
                   .otherwise(F.concat(F.lit("  "), F.upper("n_name"), F.lit(" "))).alias("name")))
    dim = n.select(F.lower(F.trim("n_name")).alias("_k"), F.col("n_nationkey").alias("Code"))
    return (raw.withColumn("_k", F.lower(F.trim("name")))
            .join(dim, "_k", "left").select("c_custkey", "Code"))


@query("semi_join_keys", R(with_(P1_CTE) + """
, ents AS (SELECT Code, row_number() OVER (ORDER BY md5(CAST(Code AS VARCHAR) || '|42'), Code) - 1 AS pos,
                  count(*) OVER () AS n FROM (SELECT DISTINCT Code FROM p1))
SELECT * FROM p1 WHERE Code IN (SELECT Code FROM ents WHERE pos < floor(n * CAST(0.70 AS DOUBLE)))""",
                           P1_DOUBLES))
def q_semi_join(spark, d):
    """JN8: keep rows whose entity is in the train split (left-semi join)."""
    from panelforge.operators.splits import geographical_split
    p = panels.nation_year_panel(spark, d)
    keys = geographical_split(p.select("Code").distinct(), "Code").filter("split = 'train'")
    return rnd(p.join(keys.select("Code"), "Code", "left_semi"))


# -------------------------------------------------------------------- reshape
@query("pivot_wide", R(with_(P1_CTE) + """
SELECT Code, Year, acctbal_mean, qty_mean, tax_mean FROM p1""", ["acctbal_mean", "qty_mean", "tax_mean"]))
def q_pivot_wide(spark, d):
    """RSH1: unpivot to long then pivot back (pivot . unpivot = id), with
    the duplicate-key check inside the one aggregate."""
    p = panels.nation_year_panel(spark, d)
    cols = ["acctbal_mean", "qty_mean", "tax_mean"]
    long = reshape.unpivot_long(p, ["Code", "Year"], cols, "measure", "val")
    return rnd(reshape.pivot_wide(long, ["Code", "Year"], "measure", "val", cols))


@query("pivot_events", R(with_(P2_CTE) + "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM p2",
                         panels.EVENT_TYPES))
def q_pivot_events(spark, d):
    """RSH1 on events: user x day wide over the event types (avg value)."""
    p = panels.user_day_panel(spark, d)
    return rnd(p.withColumn("day", F.col("day").cast("string")))


# ------------------------------------------------------------------ set / ord
@query("except_keys", with_(P1_CTE) + """
SELECT DISTINCT Code FROM p1 EXCEPT SELECT Code FROM p1 WHERE Region = 'ASIA'""")
def q_except_keys(spark, d):
    """SET2: keys of a minus keys of b (anti join)."""
    p = panels.nation_year_panel(spark, d)
    return rel.except_keys(p, p.filter(F.col("Region") == "ASIA"), ["Code"])


@query("union_all", R(with_(P1_CTE) + """
SELECT Code, Year, target AS v, 'target' AS src FROM p1 UNION ALL
SELECT Code, Year, price_mean, 'price' FROM p1""", ["v"]))
def q_union_all(spark, d):
    """SET1: concatenation by name."""
    p = panels.nation_year_panel(spark, d)
    a = p.select("Code", "Year", F.col("target").alias("v"), F.lit("target").alias("src"))
    b = p.select("Code", "Year", F.col("price_mean").alias("v"), F.lit("price").alias("src"))
    return rnd(rel.union_all([a, b]))


@query("sort_multi", R(with_(P1_CTE) + """
SELECT Code, Year, target, row_number() OVER (ORDER BY Year, Code) AS ord FROM p1""", ["target"]))
def q_sort_multi(spark, d):
    """ORD1: multi-key sort; the order is materialised as a column because
    row order is not part of a DataFrame's value."""
    from panelforge.operators.splits import global_rank
    p = panels.nation_year_panel(spark, d).select("Code", "Year", "target")
    return rnd(global_rank(p, ["Year", "Code"], "ord").withColumn("ord", F.col("ord") + 1))


@query("top_n", R(with_(P1_CTE) + """
SELECT Country, Year, target FROM p1 ORDER BY target DESC, Code, Year LIMIT 10""", ["target"]))
def q_top_n(spark, d):
    """ORD3 / ORD2: descending order + limit (TakeOrderedAndProject)."""
    p = panels.nation_year_panel(spark, d)
    return rnd(rel.top_n(p, [F.desc("target"), "Code", "Year"], 10).select("Country", "Year", "target"))


@query("sample_n", R("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || '|42'),
         CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) LIMIT 100""", ["l_extendedprice"]))
def q_sample_n(spark, d):
    """ORD4: deterministic exact-n sample (the sample size is the feature)."""
    li = table(spark, d, "lineitem").withColumn(
        "_key", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return rnd(rel.sample_n(li, "_key", 100, 42).select("l_orderkey", "l_linenumber", "l_extendedprice"))


@query("scalar_functions", R("""
SELECT n_nationkey, upper(n_name) AS up, CAST(CAST(n_nationkey AS VARCHAR) AS INTEGER) AS as_int,
       regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS slug,
       CAST(make_date(1995 + n_nationkey, 1, 1) AS VARCHAR) AS d, abs(n_regionkey - 2) AS a,
       sqrt(CAST(n_nationkey AS DOUBLE)) AS s, power(CAST(n_nationkey AS DOUBLE), 2) AS sq,
       1.5 + 0.25 * n_nationkey AS poly, coalesce(NULLIF(n_regionkey, 0), -1) AS filled,
       (NULLIF(n_regionkey, 0) IS NULL) AS was_null
FROM nation""", ["s", "sq", "poly"]))
def q_scalar_functions(spark, d):
    """FN1-FN8: upper, string->int cast, slug, year->date, abs / sqrt /
    power, linear polynomial, null test and filler."""
    from panelforge.functions.exprs import slugify, year_to_date
    n = table(spark, d, "nation")
    nr = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey"))
    return rnd(n.select(
        "n_nationkey", F.upper("n_name").alias("up"),
        F.col("n_nationkey").cast("string").cast("int").alias("as_int"),
        slugify("n_name").alias("slug"), year_to_date(F.col("n_nationkey") + 1995).cast("string").alias("d"),
        F.abs(F.col("n_regionkey") - 2).alias("a"), F.sqrt("n_nationkey").alias("s"),
        F.pow(F.col("n_nationkey").cast("double"), 2).alias("sq"),
        (F.lit(1.5) + F.lit(0.25) * F.col("n_nationkey")).alias("poly"),
        F.coalesce(nr, F.lit(-1)).alias("filled"), nr.isNull().alias("was_null")))


@query("indicator_failure_policy", """
SELECT 'k_value' AS indicator, 'merged' AS status, count(*) AS n_rows FROM events
UNION ALL SELECT 'never_present', 'skipped', 0""")
def q_failure_policy(spark, d):
    """SRC7: several indicators attached to a base; one whose pages hold no
    record (a filter nothing passes) is skipped and reported, not fatal."""
    from panelforge.sources.ingest import ingest_indicator, ingest_indicators
    pages = _indicator_pages(spark, d)
    empty = pages.filter(F.lit(False))
    base = (table(spark, d, "events")
            .select(F.upper(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("Code"),
                    F.dayofmonth("ts").alias("Year")))
    out, skipped = ingest_indicators({"k_value": pages, "never_present": empty}, base.distinct())
    assert "k_value" in out.columns and "never_present" not in out.columns
    n_rec = ingest_indicator(pages, "k_value").count()  # rows retrieved for the merged one
    rows = [("k_value", "merged", n_rec)] + [(s, "skipped", 0) for s in skipped]
    return spark.createDataFrame(rows, "indicator string, status string, n_rows long")


@query("join_left_lookup", R(with_(P1_CTE) + """
SELECT p1.Code, p1.Year, p1.target, d.r_name AS Region FROM p1
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) d
ON p1.Code = d.n_nationkey""", ["target"]))
def q_join_left_lookup(spark, d):
    """JN3: attach a per-entity attribute from a dimension (nation ->
    region, 25 rows: broadcast on a known row count), left join."""
    p = panels.nation_year_panel(spark, d).select("Code", "Year", "target")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("Code"), F.col("r_name").alias("Region"))
    return rnd(rel.lookup_join(p, dim, "Code", "left", known_rows=25))
