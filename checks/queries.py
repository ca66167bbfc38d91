"""One query per operator, each over whole tables. Doubles are rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.numbers import rounded
from auditloom.operators import (
    association,
    balance,
    catalog,
    compare,
    counts,
    fairness,
    metrics,
    model,
    neighbors,
    profile,
    quality,
    resample,
    stats,
)
from auditloom.plans.audit import Proxy, audit, audit_findings, run_audit
from auditloom.plans.evaluation import full_evaluation
from auditloom.session import shared_folder
from auditloom.sources import nulls, tables
from checks.fixtures import fixture
from checks.fixtures import tables as given_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def on(name: str, fixture_name: str, digits: int = 6):
    """Registers a function of one fixture as a query.

    Fewer digits are kept where values are large, or where two-decimal prices and
    discounts average to an exact half in the seventh digit.
    """

    def register(f: Callable[[DataFrame], DataFrame]):
        return query(name, digits)(lambda spark, sf_dir: f(fixture(spark, sf_dir, fixture_name)))

    return register


def query(name: str, digits: int = 6):
    def register(f: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # new plans are compared with every persisted one, so earlier queries' are let go
            spark.catalog.clearCache()
            return rounded(f(spark, sf_dir), digits)

        QUERIES[name] = run
        return f

    return register


def simple(name: str, fixture_name: str, f: Callable[[DataFrame], DataFrame], digits: int = 6) -> None:
    on(name, fixture_name, digits)(f)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


SENS = ["region", "segment", "priority"]
PAIRS = [("region", "segment"), ("region", "priority"), ("segment", "priority")]
DOC_SENS = ["lang", "source"]


# ------------------------------------------------------------------ sources, nulls


@query("s1_load_preview")
def _(spark, sf_dir):
    return tables.load_summary(table(spark, sf_dir, "orders"), ["o_orderkey"])


simple("s2_null_tokens_rich", "fx_dirty", lambda d: nulls.null_tokens(d, "rich"))
simple("s2_null_tokens_evaluator", "fx_dirty", lambda d: nulls.null_tokens(d, "evaluator"))
simple("s2_null_tokens_plain", "fx_dirty", lambda d: nulls.null_tokens(d, "plain"))
simple("s3_infer_types", "fx_textnum", lambda d: nulls.infer_types(nulls.null_tokens(d, "evaluator")))


@query("s4_columns")
def _(spark, sf_dir):
    found = given_tables(spark, sf_dir)
    sizes = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        sizes = one if sizes is None else sizes.unionAll(one)
    listed = tables.columns(spark, found).select("table_name", "ordinal", "column", "kind")
    return listed.join(F.broadcast(sizes), "table_name")


@query("s5_write_mitigated")
def _(spark, sf_dir):
    docs = fixture(spark, sf_dir, "fx_docs")
    folder = f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-treated"
    path = tables.write_mitigated(resample.undersample(docs, ["doc_id"], "quality"), folder, "undersampled")
    return spark.read.parquet(path)


@query("s6_write_findings")
def _(spark, sf_dir):
    docs = fixture(spark, sf_dir, "fx_docs")
    folder = f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-findings"
    found = tables.findings(balance.class_balance(docs, "quality").drop("advice"), "imbalance", "class_balance", ["label"])
    path = tables.write_findings(found, folder, "run-1")
    return spark.read.parquet(path).where("run_id = 'run-1' and stage = 'imbalance'")


# ------------------------------------------------------- projections and predicates

simple("q5_blank_to_null", "fx_dirty", nulls.blank_to_null)
simple("q16a_complete_cases", "fx_dirty", nulls.complete_cases)
simple("q16b_drop_null_target", "fx_dirty", lambda d: nulls.drop_null_target(d, "status_raw"))
simple(
    "g1_combine_columns", "fx_dirty",
    lambda d: fairness.combine_columns(d, ["priority_raw", "status_raw"]).groupBy("combined_group").agg(F.count(F.lit(1)).alias("n")),
)
simple(
    "g2_exclude_target", "fx_docs",
    lambda d: fairness.group_proportions(d, fairness.without_target(["lang", "quality", "source", "lang"], "quality")),
)

# --------------------------------------------------------------------------- profile


@query("p1_basic_info")
def _(spark, sf_dir):
    return profile.basic_info(table(spark, sf_dir, "orders"), "orders", "o_orderstatus").drop("dtype")


simple("pvc_value_counts", "fx_dirty", counts.value_counts)
simple("p2_column_preview", "fx_num", lambda d: profile.column_preview(d).drop("dtype"), digits=5)
simple("p2_sample_values", "fx_orders", profile.sample_values)
simple("p2_top_text_values", "fx_orders", profile.top_text_values)
simple("p3_sensitive_column", "fx_docs", lambda d: profile.sensitive_column(d, "source"))
simple("p3_sensitive_column_numeric", "fx_orders", lambda d: profile.sensitive_column(d, "o_totalprice"))
simple("p4_column_catalog", "fx_orders", lambda d: profile.column_catalog(d).drop("dtype"))
simple("p4b_column_summary", "fx_docs", lambda d: profile.column_summary(d).drop("dtype"))
simple("p5_numeric_stats", "fx_num", lambda d: profile.numeric_stats(d, "l_orderkey"), digits=5)
simple("p5_numeric_stats_events", "fx_events", profile.numeric_stats)
simple("p6_categorical_stats", "fx_text", profile.categorical_stats)
simple("p7_auto_profile", "fx_dirty", profile.auto_profile)
simple("p7_table_profile", "fx_dirty", quality.table_profile)
simple("p7_table_profile_repeats", "fx_dup", quality.table_profile)
simple("p4_first_values", "fx_docs", lambda d: profile.sample_values(d, 10))


@query("p2_top_texts")
def _(spark, sf_dir):
    """Whole texts and web pages, of which only the leading ones are shuffled."""
    return profile.top_text_values(table(spark, sf_dir, "documents"), 4).unionByName(profile.top_text_values(table(spark, sf_dir, "pages"), 4))


@query("p2_first_texts")
def _(spark, sf_dir):
    return profile.sample_values(table(spark, sf_dir, "documents").select("text"), 6).unionByName(
        profile.sample_values(table(spark, sf_dir, "pages").select("url", "html"), 6)
    )


@query("p6_texts")
def _(spark, sf_dir):
    return profile.categorical_stats(table(spark, sf_dir, "documents")).unionByName(profile.categorical_stats(table(spark, sf_dir, "pages")))


@query("b2_dominant_texts")
def _(spark, sf_dir):
    return balance.dominant_values(table(spark, sf_dir, "documents")).unionByName(balance.dominant_values(table(spark, sf_dir, "conversations")))


simple("p8a_spearman", "fx_num", association.spearman)
simple("p8a_spearman_nulls", "fx_dirty", lambda d: association.spearman(d.withColumn("few", F.when(F.col("days_raw") < 50, F.col("o_orderkey") % 7))))
simple("p8b_cramers_v", "fx_orders", lambda d: association.cramers_v(d, ["region", "nation", "segment", "priority", "o_orderstatus"]))

# --------------------------------------------------------------------------- quality

simple("q1_missing_by_column", "fx_dirty", quality.missing_by_column)
simple("q1_missing_only", "fx_dirty", lambda d: quality.missing_by_column(nulls.null_tokens(d, "evaluator"), only_missing=True))
simple("q2_missing_overall", "fx_dirty", lambda d: quality.missing_overall(nulls.null_tokens(d, "rich")))
simple("q3_missing_pattern", "fx_dirty", lambda d: quality.missing_pattern(nulls.null_tokens(d, "rich")))
simple("q3_missing_pattern_dup", "fx_dup", quality.missing_pattern)
simple("q4_na_tokens_found", "fx_dirty", quality.na_tokens_found)
simple("q6_type_inconsistency", "fx_dirty", quality.type_inconsistency)
simple("q6_mixed_samples", "fx_dirty", quality.mixed_type_samples)
simple("q7a_single_char_values", "fx_dirty", quality.single_char_values)
simple("q7b_blank_strings", "fx_dirty", quality.blank_strings)
simple("q7c_sentinel_numbers", "fx_dirty", quality.sentinel_numbers)
simple("q8_column_issue_report", "fx_dirty", quality.column_issue_report)
simple("q9_duplicates", "fx_dup", quality.duplicates)
simple("q9_repeated_rows", "fx_dup", quality.repeated_rows)


@query("q9_duplicates_lineitem")
def _(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"))


simple("q10_constant_columns", "fx_num", quality.constant_columns)
simple("q11_high_cardinality", "fx_text", quality.high_cardinality)
simple("q12_iqr_outliers", "fx_num", quality.iqr_outliers)
simple("q13_missing_recommendation", "fx_dirty", lambda d: quality.missing_recommendation(nulls.null_tokens(d, "rich")))
simple("q14_quality_flag", "fx_num", quality.quality_flag)
simple("q15_quality_score", "fx_docs", lambda d: quality.quality_score(d, "quality"))
simple("q15_quality_score_dup", "fx_dup", lambda d: quality.quality_score(d, "l_returnflag"))

# --------------------------------------------------------------------------- balance

simple("b1_class_balance", "fx_docs", lambda d: balance.class_balance(d, "quality"))
simple("b1_class_balance_multiclass", "fx_orders", lambda d: balance.class_balance(d, "o_orderstatus"))
simple("b2_dominant_values", "fx_text", balance.dominant_values)
simple("b2_dominant_sensitive", "fx_docs", lambda d: balance.dominant_values(d, DOC_SENS))

# --------------------------------------------------------------------------- catalog


def flagged(name: str, find: Callable[[DataFrame], DataFrame]) -> None:
    """Flags columns by name over all tables, then reads what the data says of them."""

    @query(name)
    def _(spark, sf_dir):
        found = given_tables(spark, sf_dir)
        return catalog.flagged_column_facts(found, find(catalog.catalog_of(spark, found)))


flagged("a1_guess_target", catalog.guess_target)
flagged("a2_sensitive_by_keyword", catalog.sensitive_by_keyword)
flagged("a3_sensitive_by_category", catalog.sensitive_by_category)
flagged("a4_temporal_columns", catalog.temporal_columns)
flagged("a4_temporal_columns_by_type", lambda c: catalog.temporal_columns(c, by_type=True))

# ---------------------------------------------------------------- data-level fairness

simple("f1_target_distribution", "fx_docs", lambda d: fairness.target_distribution(d, "quality"))
simple("f2_group_proportions", "fx_orders", lambda d: fairness.group_proportions(d, SENS))
simple("f3_target_rates_by_group", "fx_docs", lambda d: fairness.target_rates_by_group(d, DOC_SENS, "quality"))
simple("f3_target_rates_orders", "fx_orders", lambda d: fairness.target_rates_by_group(d, SENS, "o_orderstatus"))
simple("f4_intersectional_rates", "fx_orders", lambda d: fairness.intersectional_rates(d, PAIRS, "o_orderstatus"))
simple("f4_pair_proportions", "fx_orders", lambda d: fairness.pair_proportions(d, PAIRS))
simple(
    "f5_pairs", "fx_docs",
    lambda d: fairness.intersectional_rates(d, fairness.pairs(d, ["lang", "source", "toxic"], [("lang", "toxic"), ("lang", "absent")]), "quality"),
)
simple("f6_scale_buckets", "fx_docs", lambda d: fairness.scale_buckets(d, fairness.pairs(d, ["lang", "source", "toxic"])))
simple("f6_bucket_ranges", "fx_docs", lambda d: fairness.bucket_ranges(fairness.scale_buckets(d, fairness.pairs(d, ["lang", "source", "toxic"]))))
simple("f7_top_combinations", "fx_orders", lambda d: fairness.top_combinations(d, [("nation", "segment"), ("nation", "priority")], "o_orderstatus"))
simple("f8_modal_rate_parity", "fx_docs", lambda d: fairness.modal_rate_parity(d, DOC_SENS, "quality"))
simple("f8_modal_rate_parity_nulls", "fx_groupnull", lambda d: fairness.modal_rate_parity(d, ["priority", "status"], "y"))
simple("f9_binary_parity", "fx_docs", lambda d: fairness.binary_parity(d, ["lang", "source", "toxic"], "quality"))
simple("f9_binary_parity_nulls", "fx_groupnull", lambda d: fairness.binary_parity(d, ["priority", "status"], "y", privileged={"priority": ("1-URGENT", "Unknown")}))
simple("f10_knn_consistency", "fx_emb", lambda d: neighbors.knn_consistency(d, "vec_id", "embedding", "y", 5))
simple("f10_nearest_neighbours", "fx_emb", lambda d: neighbors.nearest_neighbours(d, "vec_id", "embedding", 5, within="y", block_rows=128))
simple("f10_nearest_of_all", "fx_emb", lambda d: neighbors.nearest_neighbours(d, "vec_id", "embedding", 7, block_rows=64))


@on("f10_lsh_recall", "fx_emb")
def _(d):
    """How many of the five nearest rows the hashed search finds: nine of ten or more."""
    exact = neighbors.nearest_neighbours(d, "vec_id", "embedding", 5).select("vec_id", "neighbour")
    hashed = neighbors.nearest_neighbours(d, "vec_id", "embedding", 5, method="lsh", near=0.3, recall=0.91).select("vec_id", "neighbour", F.lit(1).alias("hit"))
    joined = exact.join(hashed, ["vec_id", "neighbour"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_pairs"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))


# ------------------------------------------------------------------ the proxy's metrics

simple(
    "m1_encode_features", "fx_groupnull",
    lambda d: model.encode_features(d, "status", ["o_orderkey"]),
)
simple("m2_hash_split", "fx_docs", lambda d: model.stratified_split(d, ["doc_id"], "quality").select("doc_id", "quality", "is_test"))
simple("m2_exact_split", "fx_orders", lambda d: model.stratified_split(d, ["o_orderkey"], "o_orderstatus", exact=True).select("o_orderkey", "is_test"))


def proxy(
    name: str, model_type: str, params: dict | None = None, fixture_name: str = "fx_orders",
    key: str = "o_orderkey", target: str = "big", groups: list[str] = SENS, share: float = 0.5,
) -> None:
    """What does not hang on the model: test rows by group, their classes, and that in every
    group the model avoids a share of the errors that saying the commoner class makes."""

    @on(name, fixture_name)
    def _(d):
        scored = model.train_and_predict(d, [key], target, model_type, params, carry=groups)
        found = metrics.group_metrics(scored, groups, "y", "yhat", "1")
        commoner = F.greatest("base_rate", 1 - F.col("base_rate"))
        return found.select(
            "attr", "grp", "n", "base_rate", (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"),
            (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == F.col("n")).alias("adds_up"),
            (F.col("accuracy") - commoner >= share * (1 - commoner)).alias("learns"),
        )


proxy("m3_random_forest", model.FOREST)
proxy("m3_gradient_boosting", model.BOOSTING)
proxy("m3_logistic_regression", model.LOGISTIC)
proxy("m3_linear_svm", model.LINEAR_SVM)

# a target that no feature gives away, and whose class lies between two of the other
LINES = {"fixture_name": "fx_lines", "key": "l_orderkey", "target": "middling", "groups": ["priority"], "share": 1 / 3}
proxy("m3_kernel_svm", model.SVM, {"max_iter": 20}, **LINES)
proxy("m3_random_forest_lines", model.FOREST, {"n_estimators": 20, "max_depth": 6}, **LINES)


@on("m3_svm_probability", "fx_lines")
def _(d):
    """Tested rows by class, that their probabilities are some, and as high as they are right."""
    scored = model.train_and_predict(d, ["l_orderkey"], "middling", model.SVM, {"max_iter": 20}, probability=True).persist()
    p, right = F.col("probability"), (F.col("y") == F.col("yhat")).cast("double")
    gap = scored.groupBy(F.floor(p * 5)).agg(F.abs(F.sum(p) - F.sum(right)).alias("gap")).agg(F.sum("gap")).scalar()
    n_all = scored.agg(F.count(F.lit(1))).scalar()
    return scored.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(p.between(0.0, 1.0)).alias("n_between")).select(
        "y", "n", "n_between", (gap / n_all < 0.1).alias("calibrated")
    )


simple("m4_classification_report", "fx_pred3", lambda d: metrics.classification_report(d, "y", "yhat"))
simple("m4_classification_summary", "fx_pred3", lambda d: metrics.classification_summary(d, "y", "yhat"))
simple("m4_confusion_matrix", "fx_pred3", lambda d: metrics.confusion_matrix(d, "y", "yhat"))
simple("m5_group_metrics", "fx_pred", lambda d: metrics.group_metrics(d, ["segment", "region"], "y", "yhat"))
simple("m5_group_metrics_multiclass", "fx_pred3", lambda d: metrics.group_metrics(d, ["segment"], "y", "yhat"))
simple("m6_prediction_parity", "fx_pred", lambda d: metrics.prediction_parity(metrics.group_metrics(d, ["segment", "region"], "y", "yhat")))
simple("m7_intersectional_metrics", "fx_pred", lambda d: metrics.group_metrics(d, [("segment", "region")], "y", "yhat"))
simple("m8_error_rate_ratios", "fx_pred", lambda d: metrics.error_rate_ratios(metrics.group_metrics(d, ["segment", "region"], "y", "yhat")))

# ------------------------------------------------------------------------- mitigation

simple("r1_reweight", "fx_docs", lambda d: resample.reweight(d, "quality", ["lang"]))
simple("r1_reweight_pair", "fx_groupnull", lambda d: resample.reweight(d, "y", ["priority", "status"]))
simple("r1_reweight_null_group", "fx_groupnull", lambda d: resample.reweight(d, "y", ["priority"]))
simple("r1b_weight_stats", "fx_orders", lambda d: resample.weight_stats(resample.reweight(d, "big", ["region", "segment"])))
simple("r1b_weighted_distribution", "fx_orders", lambda d: resample.weighted_distribution(resample.reweight(d, "big", ["region", "segment"]), "big"))
simple("r5_sampling_plan", "fx_orders", lambda d: resample.sampling_plan(resample.class_counts(d, "o_orderstatus"), "auto", "over"))
simple("r5_sampling_plan_under", "fx_orders", lambda d: resample.sampling_plan(resample.class_counts(d, "o_orderstatus"), "majority", "under"))
simple(
    "r2_smote_vectors", "fx_emb",
    lambda d: resample.synthetic_vectors(d, "vec_id", "embedding", "y", k=5, block_rows=64).select(
        "base_key", "neighbour_key", "draw", "label",
        F.get("features", F.lit(0)).alias("x_first"), F.get("features", F.lit(63)).alias("x_last"),
        F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("x_sum"),
    ),
)
simple(
    "r2_smote_rows", "fx_docs",
    lambda d: resample.smote(d, "doc_id", "quality", k=5).groupBy("quality", "synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("made_from").alias("n_origins"), F.count_distinct("doc_id").alias("n_keys"),
        F.count_if(F.col("lang").isNull() | F.col("source").isNull()).alias("n_unknown"),
        (F.max("n_chars") <= F.lit(1_000_000)).alias("bounded"), F.max("toxic").alias("most_toxic"),
    ),
)
simple("r3_oversample", "fx_docs", lambda d: resample.oversample(d, ["doc_id"], "quality"))
simple("r3_oversample_multiclass", "fx_orders", lambda d: resample.oversample(d, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "o_orderstatus", "draw"))
simple("r4_undersample", "fx_docs", lambda d: resample.undersample(d, ["doc_id"], "quality"))
simple("r4_undersample_multiclass", "fx_orders", lambda d: resample.undersample(d, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "o_orderstatus"))
simple("r6_mitigation_summary", "fx_docs", lambda d: resample.mitigation_summary(d, resample.oversample(d, ["doc_id"], "quality"), "quality"))

# ------------------------------------------------------------------------- comparison

simple("c1_compare_size", "fx_orders", lambda d: compare.compare_size(d, resample.undersample(d, ["o_orderkey"], "big")))
simple("c2_compare_target", "fx_orders", lambda d: compare.compare_target(d, resample.undersample(d, ["o_orderkey"], "big"), "big"))
simple("c3_compare_target_weighted", "fx_orders", lambda d: compare.compare_target_weighted(d, resample.reweight(d, "big", ["region"]), "big"))
simple("c4_compare_sensitive", "fx_docs", lambda d: compare.compare_sensitive(d, resample.undersample(d, ["doc_id"], "quality"), DOC_SENS))


def _method_rows(d: DataFrame) -> list[DataFrame]:
    return [
        compare.compare_imbalance(d, resample.reweight(d, "quality", ["lang"]), "quality", "reweighted"),
        compare.compare_imbalance(d, resample.oversample(d, ["doc_id"], "quality"), "quality", "oversampled"),
        compare.compare_imbalance(d, resample.undersample(d, ["doc_id"], "quality"), "quality", "undersampled"),
    ]


simple("c5_compare_imbalance", "fx_docs", lambda d: _method_rows(d)[0])
simple("c7_rank_methods", "fx_docs", lambda d: compare.rank_methods(_method_rows(d)))


def _two_parities(d: DataFrame) -> DataFrame:
    sides = [metrics.prediction_parity(metrics.group_metrics(d, ["segment", "region"], "y", p)) for p in ("yhat", "yhat2")]
    return compare.compare_fairness(*sides)


simple("c6_compare_fairness", "fx_pred", _two_parities)
simple("c6_fairness_effect", "fx_pred", lambda d: compare.fairness_effect(_two_parities(d)))
simple("c6_fairness_effect_metrics", "fx_pred", lambda d: compare.fairness_effect(_two_parities(d), total="metrics"))


@query("c8_inventory_outputs")
def _(spark, sf_dir):
    docs = fixture(spark, sf_dir, "fx_docs")
    folder = f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-inventory"
    tables.write_mitigated(resample.reweight(docs, "quality", ["lang"]), folder, "reweighted")
    tables.write_mitigated(resample.undersample(docs, ["doc_id"], "quality"), folder, "undersampled")
    return tables.inventory_outputs(spark, folder, ["reweighted", "undersampled"])


@query("c8_preview_outputs")
def _(spark, sf_dir):
    docs = fixture(spark, sf_dir, "fx_docs")
    folder = f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-preview"
    tables.write_mitigated(resample.undersample(docs, ["doc_id"], "quality"), folder, "undersampled")
    tables.write_mitigated(docs, folder, "given")
    return tables.preview_outputs(spark, folder, ["given", "undersampled"], ["doc_id"])


# ------------------------------------------------------------------------- statistics

simple("t1_high_correlations", "fx_num", association.high_correlations)
simple("t1_pearson", "fx_num", lambda d: association.pearson(d, [c for c in d.columns if c != "const_col"]))
simple("t2_normality_screen", "fx_num", stats.normality_screen, digits=3)
simple("t2_shapiro_francia", "fx_num", stats.shapiro_francia)
simple("t2_shapiro_francia_events", "fx_events", stats.shapiro_francia)
simple("t3_variation_risk", "fx_num", stats.variation_risk)
simple("t3_drift_recommendation", "fx_num", stats.drift_recommendation)

# ------------------------------------------------------------------------ whole audits


@on("o1_audit", "fx_orders")
def _(d):
    return audit_findings(audit(d, "o_orderkey", "big", ["region", "segment", "big"], methods=["reweighted", "undersampled"]))


@on("o1_audit_quality", "fx_dirty")
def _(d):
    return audit_findings(audit(d, "o_orderkey", "status_raw", ["priority_raw"]))


@query("o1_audit_resumed")
def _(spark, sf_dir):
    """An audit run twice over the same rows in another order: the second reads what is there."""
    orders = fixture(spark, sf_dir, "fx_orders")
    folder = f"{shared_folder(spark)}/{sf_dir.strip('/').replace('/', '-')}-audits"
    for rows in (orders, orders.repartition("segment")):
        found = run_audit(rows, "o_orderkey", folder, "big", ["region", "segment", "big"], methods=["reweighted", "undersampled"])
    return found.select("stage", "operator", "subject", "metric", "value_double", "value_string")


#: What of a classifier's findings does not hang on the model.
SETTLED_METRICS = ["n", "base_rate", "support", "n_orig", "n_mit"]


@on("o1_audit_proxy", "fx_orders")
def _(d):
    """The audit with a proxy model, before and after a treatment: all rows of its findings;
    values that hang on the model are checked to be shares, or left out."""
    results = audit(d, "o_orderkey", "big", ["region", "segment"], methods=["reweighted"], proxy=Proxy(model.LOGISTIC))
    kept = ["classification_report", "classification_summary", "group_metrics", "prediction_parity", "error_rate_ratios", "compare_fairness"]
    found = audit_findings([r for r in results if r.operator in [*kept, "intersectional_group_metrics"]])
    is_share = F.col("metric").isin(SHARES)
    return found.where(is_share | F.col("metric").isin(SETTLED_METRICS)).select(
        "stage", "operator", "subject", "metric",
        F.when(F.col("metric").isin(SETTLED_METRICS), F.col("value_double")).alias("value"),
        F.when(is_share, F.coalesce(F.col("value_double").between(0.0, 1.0), F.lit(True))).alias("is_share"),
    )


SHARES = ["accuracy", "f1_macro", "f1_weighted", "precision", "recall", "f1", "selection_rate", "tpr", "tnr", "fpr", "fnr", "spd"]


@on("o2_full_evaluation", "fx_docs")
def _(d):
    return audit_findings(full_evaluation(d, "quality", DOC_SENS, "docs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of a staged audit of the labelled documents, in long form."""
    docs = fixture(spark, sf_dir, "fx_docs")
    return rounded(audit_findings(audit(docs, "doc_id", "quality", DOC_SENS, methods=["reweighted", "undersampled"])))


