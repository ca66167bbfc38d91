"""Hand-computed frames for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import balance, catalog, compare, fairness, metrics, profile, quality, resample
from auditloom.sources import nulls


def test_modal_rate_takes_each_groups_largest_class(spark, rows):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 1)], "g string, y int")
    df = df.union(spark.createDataFrame([("a", 0), ("a", 1)], "g string, y int"))
    # a: 3 of 5 are 0; b: all are 1
    got = fairness.modal_rate_parity(df, ["g"], "y")
    assert rows(got) == [("g", 2, 1.0, 0.6, 0.4, "SIGNIFICANT_DISPARITY")]


@pytest.mark.parametrize(
    "share, level", [(91, "FAIR"), (90, "FAIR"), (89, "MINOR_DISPARITY"), (79, "SIGNIFICANT_DISPARITY")]
)
def test_parity_levels(spark, share, level):
    df = spark.createDataFrame(
        [("a", 1, 100), ("b", 1, share), ("b", 0, 100 - share)], "g string, y int, n bigint"
    ).where("n > 0")
    got = fairness.modal_rate_parity(df, ["g"], "y", cells=df).first()
    # 1 - 0.9 lies just below 0.1 in binary
    assert got["level"] == level


def test_weights_by_group(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "b", 1), (5, None, 1), (6, "a", None)], "id int, g string, y int"
    )
    got = resample.reweight(df, "y", ["g"])
    # the row without a target counts for its group's size
    assert rows(got.select("id", "sample_weight")) == [(1, 1.0), (2, 1.0), (3, 2.0), (4, 0.5), (5, 1.0), (6, 1.0)]
    full = df.where("y is not null")
    assert rows(resample.reweight(full, "y", ["g"]).select("id", "sample_weight")) == [
        (1, 0.75), (2, 0.75), (3, 1.5), (4, 0.5), (5, 1.0),
    ]


def test_a_null_is_a_group_of_its_own_with_two_columns(spark, rows):
    df = spark.createDataFrame([(1, "a", None, 0), (2, "a", None, 1), (3, "a", "x", 1)], "id int, g string, h string, y int")
    got = resample.reweight(df, "y", ["g", "h"]).select("id", "combined_group", "sample_weight")
    assert rows(got) == [(1, "a_nan", 1.0), (2, "a_nan", 1.0), (3, "a_x", 0.5)]


def test_pairs_of_groups_are_not_glued_together(spark, rows):
    df = spark.createDataFrame([("x_y", "z", 0), ("x", "y_z", 1)], "a string, b string, y int")
    got = fairness.intersectional_rates(df, [("a", "b")], "y")
    assert rows(got) == [("a_b", "x_y_z", "0", 1, 1, 100.0), ("a_b", "x_y_z", "1", 1, 1, 100.0)]


def test_texts_that_read_as_numbers(spark, rows):
    texts = ["12", "-3.5", "1-2", "3.", "2020-01-01", "1e5", ".", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert rows(quality.type_inconsistency(df)) == [("c", 4, 4, True)]


def test_duplicates_treat_nulls_as_equal(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    assert rows(quality.duplicates(df)) == [(5, 2, 40.0)]


def test_null_positions_are_part_of_the_row_hash(spark, rows):
    df = spark.createDataFrame([(1, None), (None, 1), (None, None)], "a int, b int")
    assert df.select(quality._row_hash(df)).distinct().count() == 3
    assert rows(quality.duplicates(df)) == [(3, 0, 0.0)]


def test_corrected_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 10)], "x double")
    r = profile.numeric_stats(df).first()
    assert r["skew"] == pytest.approx(2.028699102, abs=1e-8)
    assert r["kurt"] == pytest.approx(4.272146532, abs=1e-8)
    assert r["std"] == pytest.approx(3.646916506, abs=1e-8)
    assert r["median"] == 2.0 and r["n_unique"] == 4


def test_moments_of_few_rows_are_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = profile.numeric_stats(df).first()
    assert r["skew"] is None and r["kurt"] is None and r["median"] == 1.5


def test_parity_skips_zero_rates_in_the_impact(spark, rows):
    df = spark.createDataFrame([("g", "a", 0.0), ("g", "b", 0.2), ("g", "c", 0.5)], "attr string, grp string, selection_rate double")
    assert rows(metrics.prediction_parity(df)) == [("g", 0.5, 0.4, "c", "a")]


def test_parity_without_any_positive_is_zero(spark, rows):
    df = spark.createDataFrame([("g", "a", 0.0), ("g", "b", 0.0)], "attr string, grp string, selection_rate double")
    assert rows(metrics.prediction_parity(df)) == [("g", 0.0, 0.0, "a", "a")]


@pytest.mark.parametrize(
    "big, small, status",
    [(14, 10, "BALANCED"), (15, 10, "SLIGHTLY_IMBALANCED"), (30, 10, "IMBALANCED"), (100, 10, "HIGHLY_IMBALANCED")],
)
def test_imbalance_levels(spark, big, small, status):
    df = spark.range(big + small).select((F.col("id") < small).cast("int").alias("y"))
    assert {r["status"] for r in balance.class_balance(df, "y").collect()} == {status}


def test_dominance_needs_more_than_65_percent_rounded(spark):
    for hits, found in ((6500, False), (6501, True)):
        df = spark.range(10000).select(F.when(F.col("id") < hits, "a").otherwise(F.col("id").cast("string")).alias("c"))
        assert (balance.dominant_values(df).count() > 0) is found


def test_four_fifths_rule_edges(spark):
    # 0.4 / 0.5 and 0.625 / 0.5 are exactly 0.8 and 1.25 in binary, too
    for rate, ok in ((400, True), (399, False), (625, True), (626, False)):
        cells = spark.createDataFrame(
            [("a", 1, rate), ("a", 0, 1000 - rate), ("b", 1, 500), ("b", 0, 500)], "g string, y int, n bigint"
        )
        r = fairness.binary_parity(cells, ["g"], "y", cells=cells).first()
        assert r["unpriv"] == "a" and r["priv"] == "b"
        assert r["status"].startswith("ACCEPTABLE") is ok


def test_binary_parity_needs_two_labels(spark):
    cells = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("b", 2, 1)], "g string, y int, n bigint")
    assert fairness.binary_parity(cells, ["g"], "y", cells=cells).count() == 0


def test_numeric_groups_keep_numeric_order(spark):
    cells = spark.createDataFrame([(10, 0, 1), (9, 1, 1), (100, 1, 1)], "g int, y int, n bigint")
    r = fairness.binary_parity(cells, ["g"], "y", cells=cells).first()
    assert (r["unpriv"], r["priv"]) == ("9", "10")


def test_effect_cannot_reach_the_top_by_attributes(spark):
    every = spark.createDataFrame([("a", True, True), ("b", True, True)], "attr string, spd_improved boolean, di_improved boolean")
    assert compare.fairness_effect(every).first()["overall"] == "Moderate"
    assert compare.fairness_effect(every, total="metrics").first()["overall"] == "Significant"
    none = every.select("attr", F.lit(False).alias("spd_improved"), F.lit(False).alias("di_improved"))
    assert compare.fairness_effect(none).first()["overall"] == "None or Negative"


def test_single_characters_must_repeat(spark, rows):
    df = spark.createDataFrame([("x",), ("x",), (" y",), ("z",), ("zz",), (None,)], "c string")
    assert rows(quality.single_char_values(df).select("pattern", "n")) == [("Single character 'x'", 2)]


def test_tokens_match_exactly(spark, rows):
    df = spark.createDataFrame([("?",), ("unknown",), (" ?",), ("UnKnown",), ("",), ("NA",)], "c string")
    kept = {v: [r[0] for r in nulls.null_tokens(df, v).dropna().collect()] for v in ("plain", "evaluator", "rich")}
    assert kept["plain"] == ["?", "unknown", " ?", "UnKnown"]
    assert kept["evaluator"] == ["unknown", " ?", "UnKnown"]
    assert kept["rich"] == [" ?", "UnKnown"]


def test_types_follow_the_texts(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None, "1d"), ("-2", "1e3", "2", None, "2")], "a string, b string, c string, d string, e string")
    got = nulls.infer_types(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "string", "string", "string"]


def test_nan_counts_as_missing(spark, rows):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert rows(quality.missing_by_column(df)) == [("x", 2, 66.666667)]
    assert profile.numeric_stats(df).first()["mean"] == 1.0
    assert nulls.complete_cases(df).count() == 1


def test_missing_recommendations(spark):
    for n_null, word in ((0, "No missing"), (20, "Minor"), (21, "WARNING"), (51, "CRITICAL")):
        df = spark.range(100).select(F.when(F.col("id") >= n_null, F.col("id")).alias("x"))
        assert quality.missing_recommendation(df).first()[0].startswith(word)


def test_quality_score_is_floored_and_graded(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), F.col("id").alias("k"))
    r = quality.quality_score(df, "y").first()
    assert (r["score"], r["grade"], r["ready"]) == (100.0, "A - EXCELLENT", True)


def test_tables_without_text_or_numbers(spark):
    numbers = spark.range(10).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2).alias("z"))
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    assert quality.column_issue_report(numbers).count() == 0
    assert quality.column_issue_report(texts).count() == 1
    assert quality.high_cardinality(numbers).count() == 0
    assert quality.iqr_outliers(texts).count() == 0
    assert profile.numeric_stats(texts).count() == 0
    assert quality.quality_flag(numbers).first()["flag"] == "GOOD"


def test_names_with_dots_and_dashes(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "`marital-status` string, `x.y` double")
    assert rows(quality.missing_by_column(df)) == [("marital-status", 0, 0.0), ("x.y", 1, 50.0)]
    assert profile.column_preview(df).count() == 2
    assert profile.numeric_stats(df).first()["column"] == "x.y"
    assert quality.duplicates(df).first()["n_duplicates"] == 0


NAMES = [
    ("adult", 0, "age"), ("adult", 1, "workclass"), ("adult", 2, "marital-status"), ("adult", 3, "race"),
    ("adult", 4, "sex"), ("adult", 5, "native-country"), ("adult", 6, "income"), ("loans", 0, "customer_name"),
    ("loans", 1, "loan_date"), ("loans", 2, "credit_score"), ("loans", 3, "language"),
]


def test_guesses_from_names(spark, rows):
    df = spark.createDataFrame([(*n, "string", "categorical") for n in NAMES], "table_name string, ordinal int, column string, dtype string, kind string")
    assert rows(catalog.guess_target(df)) == [("adult", "income"), ("loans", "language")]
    assert {r["column"] for r in catalog.sensitive_by_keyword(df).collect()} == {"age", "marital-status", "race", "sex", "language"}
    by_category = {(r["column"], r["category"]) for r in catalog.sensitive_by_category(df).collect()}
    assert ("credit_score", "financial") in by_category and ("customer_name", "personal_identifiers") in by_category
    assert ("workclass", "protected_attributes") not in by_category
    assert rows(catalog.temporal_columns(df)) == [("loans", "loan_date")]
    assert {r["table_name"] for r in catalog.privacy_warning(df).collect()} == {"adult", "loans"}


def test_target_is_never_sensitive():
    assert fairness.without_target(["a", "y", "b", "a"], "y") == ["a", "b"]


def test_pairs_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert fairness.pairs(df, ["a"]) == []
    assert fairness.pairs(df, ["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert fairness.pairs(df, ["a", "b", "c"], [("a", "c"), ("a", "z")]) == [("a", "c")]


@pytest.mark.parametrize(
    "strategy, direction, expected",
    [
        ("auto", "over", {"a": 9, "b": 9, "c": 9}),
        ("minority", "over", {"a": 9, "b": 5, "c": 9}),
        ("not minority", "over", {"a": 9, "b": 9, "c": 2}),
        ("auto", "under", {"a": 2, "b": 2, "c": 2}),
        ("majority", "under", {"a": 2, "b": 5, "c": 2}),
        ("not majority", "under", {"a": 9, "b": 2, "c": 2}),
    ],
)
def test_sampling_plans(spark, strategy, direction, expected):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 2)], "label string, n bigint")
    got = {r["label"]: r["target_n"] for r in resample.sampling_plan(counts, strategy, direction).collect()}
    assert got == expected


def test_plans_refuse_what_does_not_fit(spark):
    counts = spark.createDataFrame([("a", 9)], "label string, n bigint")
    with pytest.raises(ValueError):
        resample.sampling_plan(counts, "majority", "over")
    with pytest.raises(ValueError):
        resample.sampling_plan(counts, "minority", "under")
