"""Public operator surface (DataFrame in, DataFrame out), one import away.

    from basketry import api as B
    feat = B.derive_features(B.clean_shoppers(B.canonical_columns(B.normalize_columns(raw))))
"""

from __future__ import annotations

from basketry.functions.exprs import climate_group, concat_text, cut, lookup  # noqa: F401
from basketry.operators.crm import (crm_action, crm_display, crm_summary, filter_below_mean,  # noqa: F401
                                    risk_actions, segment_names_fixed, segment_names_rule,
                                    segment_playbook, segment_profile, segment_recommendation,
                                    segment_risk)
from basketry.operators.encode import (class_weights, encode_train_test, fit_standardizer,  # noqa: F401
                                       fit_vocabulary, label_encode, one_hot_apply, one_hot_full,
                                       standardize, standardize_apply, with_class_weight)
from basketry.operators.features import (align_schema, clean_shoppers, conditional_prob_features,  # noqa: F401
                                         derive_features, drop_columns, drop_leakage, fill_missing,
                                         fit_conditional_probs, group_mean_ratio, group_transform_mean,
                                         map_conditional_probs, qcut, rare_encode, relabel, topk_group)
from basketry.operators.metrics import (auc, best_threshold, classification_report,  # noqa: F401
                                        compare_models, confusion_matrix, default_vs_tuned, roc_curve,
                                        threshold_sweep)
from basketry.operators.models import (Scorer, TrainConfig, candidate_features, coefficients,  # noqa: F401
                                       cross_validate, earlier_config, earlier_models, feature_importance,
                                       fitted_scores, grid_search, load_scorer, score_candidates,
                                       score_customers, select_features, train_pipeline)
from basketry.operators.quantiles import column_quantiles, quantiles  # noqa: F401
from basketry.operators.ranking import row_number_in_group  # noqa: F401
from basketry.operators.segments import (add_segment, assign_nearest, elbow_inertias, elbow_k, elbow_segments,  # noqa: F401
                                         kmeans_segments, pca_project, silhouette, silhouette_euclidean)
from basketry.operators.split import add_split_column, fold_column, stratified_split  # noqa: F401
from basketry.operators.stats import (box_stats, correlation_matrix, cramers_v,  # noqa: F401
                                      cramers_v_value, crosstab_counts, crosstab_row_pct, crosstab_wide,
                                      distinct_count, drop_if_associated, group_mode, group_sizes, kde,
                                      kpi_summary, quantile_table, rate_by_group, top_counts,
                                      value_distribution, violin)
from basketry.sources.files import canonical_columns, coerce_numeric, normalize_columns, scan_csv, scan_parquet  # noqa: F401
from basketry.streaming.scoring import run_score_stream, score_stream  # noqa: F401

one_hot_fit = fit_vocabulary
quantile_cutoffs = quantile_table
segment_names = segment_names_rule


def crosstab(df, a, b, normalize=None):
    """Wide contingency table; ``normalize="index"`` gives row percentages."""
    return crosstab_row_pct(df, a, b) if normalize == "index" else crosstab_wide(df, a, b)


violin_stats = violin
