"""The eleven-section evaluation of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from auditloom.functions.columns import string_columns
from auditloom.operators import association, balance, catalog, fairness, profile, quality, stats
from auditloom.plans.audit import Result, guessed_sensitive, guessed_target
from auditloom.session import settled
from auditloom.sources.nulls import null_tokens


def full_evaluation(
    df: DataFrame, target: str | None = None, sensitive: Sequence[str] | None = None, name: str = "table"
) -> list[Result]:
    """Every section; building them looks at the data, the results are lazy."""
    df = null_tokens(df, "evaluator")
    target = target or guessed_target(df)
    sensitive = fairness.without_target(sensitive if sensitive is not None else guessed_sensitive(df, target), target)
    columns = catalog.catalog_of(df.sparkSession, {name: df})
    # several sections speak of these, so they are computed once: a row each, or one per column
    repeated, overall = settled(quality.duplicates(df)), settled(quality.missing_overall(df))
    constant, many = settled(quality.constant_columns(df)), settled(quality.high_cardinality(df))
    out = [
        Result("basic_info", "basic_info", profile.basic_info(df, name, target), ["column"]),
        Result("missing_data", "missing_by_column", quality.missing_by_column(df, only_missing=True), ["column"]),
        Result("missing_data", "missing_overall", overall),
        Result("missing_data", "missing_pattern", quality.missing_pattern(df), ["pattern"]),
        Result("missing_data", "missing_recommendation", quality.missing_recommendation(df)),
        Result("data_quality", "duplicates", repeated),
        Result("data_quality", "constant_columns", constant, ["column"]),
        Result("data_quality", "high_cardinality", many, ["column"]),
        Result("data_quality", "iqr_outliers", quality.iqr_outliers(df), ["column"]),
        Result("data_quality", "quality_flag", quality.quality_flag(df, repeated, constant, many)),
        Result("class_balance", "class_balance", balance.class_balance(df, target), ["label"]),
        Result("feature_analysis", "numeric_stats", profile.numeric_stats(df, target), ["column"]),
        Result("sensitive_labels", "sensitive_by_category", catalog.sensitive_by_category(columns), ["table_name", "column"]),
        Result("sensitive_labels", "privacy_warning", catalog.privacy_warning(columns), ["table_name"]),
        Result("statistical_tests", "normality_screen", stats.normality_screen(df), ["column"]),
        Result("statistical_tests", "high_correlations", association.high_correlations(df), ["column_a", "column_b"]),
        Result("drift_risk", "variation_risk", stats.variation_risk(df), ["column"]),
        Result("drift_risk", "drift_recommendation", stats.drift_recommendation(df)),
        Result("automated_profiling", "table_profile", quality.table_profile(df, repeated)),
        Result("automated_profiling", "auto_profile", profile.auto_profile(df), ["column"]),
        Result("overall_quality_score", "quality_score", quality.quality_score(df, target, repeated, overall)),
    ]
    if string_columns(df, exclude=[target]):
        out.append(Result("feature_analysis", "categorical_stats", profile.categorical_stats(df, target), ["column"]))
        out.append(Result("feature_analysis", "top_text_values", profile.top_text_values(df), ["column", "rank"]))
    if sensitive:
        out += [
            Result("fairness_analysis", "modal_rate_parity", fairness.modal_rate_parity(df, sensitive, target), ["attr"]),
            Result("fairness_analysis", "binary_parity", fairness.binary_parity(df, sensitive, target), ["attr"]),
            Result("fairness_analysis", "modal_group_rates", fairness.modal_group_rates(df, sensitive, target), ["attr", "grp"]),
        ]
    return out
