"""SURVEY §2 keys that are implemented by a query registered under another
name: the same builder (and the same SQL twin) is registered again under
the survey key, so the inventory can be checked line by line."""

from panelforge.plans.registry import ORACLES, QUERIES

# survey key -> registered query that implements it
SURVEY_ALIASES = {
    "dim_from_config": "map_label",                 # SRC6
    "sink_parquet": "scan_by_extension",            # SNK1 (write + read back)
    "sink_by_extension": "scan_by_extension",       # SNK2
    "export_bundle": "bi_bundle",                   # SNK3
    "model_save_load": "batch_score_model",         # SNK4
    "format_label": "literal_tag",                  # PRJ7
    "residual_columns": "chart_resid_scatter",      # PRJ9
    "severity_bucket": "vif_three",                 # PRJ10
    "join_inner_suffix": "chart_rmse",              # JN4
    "join_model_vs_model": "chart_pred_compare",    # JN5
    "join_group_means": "chart_region_compare",     # JN6
    "join_level_trend": "group_mean_profile",       # JN7
    "join_last_known": "naive_persistence",         # JN9
    "join_forecast_rows": "future_forecast_table",  # JN11
    "dict_of_tables_to_long": "model_comparison",   # RSH3
    "sort_desc_result": "skewness_table",           # ORD2
    "best_params": "grid_search",                   # ML13
    "trend_with_predictions": "trend_with_connector",   # RPT3
    "shap_importance_table": "mean_abs_importance",     # RPT4
    "temporal_persistence_check": "persistence_comparison",  # RPT8
    "chart_group_trend": "trend_by_group",          # CH2
    "chart_box": "boxplot_stats",                   # CH3
    "chart_vif": "vif_three",                       # CH7
    "chart_error_period": "error_by_period",        # CH12
    "chart_elbow": "kmeans_sweep",                  # CH18
    "chart_cluster_pca": "cluster_lookup",          # CH20
}

for key, target in SURVEY_ALIASES.items():
    if key in QUERIES:
        raise KeyError(f"alias {key} collides with a registered query")
    QUERIES[key] = QUERIES[target]
    if target in ORACLES:
        ORACLES[key] = ORACLES[target]
