"""Registered queries vs their DuckDB twins on the smallest test data
(the driver runs every key at sf0.01; this is a fast sample)."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["panel_nation_year", "trend_by_group", "scan_csv_long", "pivot_wide", "join_left_equi_multi",
          "iqr_outliers", "describe", "corr_matrix", "impute_trend", "temporal_split",
          "geographical_split", "timeseries_cv", "robust_scale", "ari_nmi", "silhouette",
          "ridge_one_feature", "grid_search_ridge_1f", "ar1_diff_ls", "shap_linear", "chart_region_trend",
          "stream_score", "customer_profile"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_oracle(spark, con, key):
    s = E.queries()[key](spark, SF).toPandas()
    d = con.execute(E.oracle_sql()[key]).df()
    sc, sr = rows_of(s)
    dc, dr = rows_of(d)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Region", "Year", "mean_target", "n_entities"]


def test_impute_events_matches_sql_within_tolerance(spark, con):
    from panelforge.plans.queries_time import IMPUTE_EVENTS_SQL
    s = E.queries()["impute_events"](spark, SF).toPandas().sort_values(["user_id", "day_idx"])
    d = con.execute(IMPUTE_EVENTS_SQL).df().sort_values(["user_id", "day_idx"])
    assert len(s) == len(d)
    for c in ["view", "signup", "error", "click", "purchase"]:
        a, b = s[c].to_numpy(), d[c].to_numpy()
        assert ((pd.isna(a)) == (pd.isna(b))).all()
        m = ~pd.isna(a)
        assert abs(a[m] - b[m]).max() < 1e-6
