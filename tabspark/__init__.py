"""Tables prepared and modelled with Spark: every operator is a function of DataFrames."""

from .operators.charts import boxplot_stats, correlation_heatmap, density, distribution, histogram
from .operators.columns import (
    apply_casts,
    apply_clip,
    apply_fill,
    cast_types,
    clip_report,
    clip_values,
    drop_columns,
    drop_high_cardinality,
    drop_high_missing,
    fill_missing,
    fill_report,
    fit_casts,
    fit_clip,
    fit_fill,
    fit_high_cardinality,
    fit_high_missing,
    remaining_nulls,
    rename_columns,
    replace_report,
    replace_values,
    select_features,
    strip_whitespace,
)
from .operators.evaluation import (
    accuracy,
    auc,
    average_precision,
    calibration,
    calibration_gap,
    classification_metrics,
    confusion_matrix,
    mismatch_rate,
    pr_curve,
    prediction_sample,
    regression_metrics,
    report,
    residual_grid,
    residual_histogram,
    residual_points,
    residual_range,
    residuals,
    roc_curve,
    score_histogram,
)
from .operators.features import (
    aggregate_features,
    apply_bins,
    apply_encoding,
    apply_interactions,
    apply_log,
    apply_ratios,
    bin_continuous,
    bin_counts,
    create_interactions,
    create_polynomials,
    create_ratios,
    datetime_failures,
    datetime_parts,
    encode_categorical,
    fit_bins,
    fit_encoding,
    fit_interactions,
    fit_log,
    fit_ratios,
    log_report,
    log_transform,
    ratio_report,
)
from .operators.joins import merge_shapes, merge_tables
from .operators.models import (
    TrainedModel,
    class_probabilities,
    coefficients,
    compare_models,
    cross_validate,
    cv_summary,
    feature_importance,
    fit_model,
    learning_curve,
    load_model,
    make_spec,
    preview_predictions,
    rank_features,
    retrain_full,
    save_model,
    save_predictions,
    score,
    train,
    tune,
)
from .operators.profiling import (
    check_leakage,
    correlations,
    detect_outliers,
    head,
    identify_target,
    missing_patterns,
    missingness,
    outlier_rows,
    profile,
    stage_summary,
    top_correlations,
    top_safe,
)
from .operators.rows import (
    drop_duplicates,
    drop_missing_target,
    filter_rows,
    remove_outliers,
    semi_filter,
    subsample,
    subsample_related,
)
from .operators.selection import (
    drop_correlated,
    drop_low_variance,
    fit_k_best,
    k_best_report,
    score_features,
    select_k_best,
)
from .operators.splits import (
    apply_scaler,
    class_balance,
    class_distribution,
    create_folds,
    fit_scaler,
    fold_summary,
    scale_features,
    scaler_report,
    separate_features_target,
    shapes,
    split_data,
    split_summary,
)
from .sources import (
    concat_tables,
    content_fingerprint,
    load_table,
    read_registry,
    register_version,
    rows_per_source,
    save_table,
    validate_source,
)
from .streaming import read_stream, run_available, stream_duplicates_dropped

__all__ = sorted(n for n in dir() if not n.startswith("_") and n not in ("operators", "sources", "streaming", "functions"))
