"""Column profiles: basic facts, previews, numeric and categorical statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.columns import (
    flat_columns,
    kind_of,
    number,
    numeric_columns,
    row_count,
    string_columns,
)
from auditloom.functions.numbers import ratio, sample_kurtosis, sample_skewness
from auditloom.functions.quantiles import exact_quantiles, quantile_frame
from auditloom.operators.counts import column_facts, keyed_counts, leading_values, top_values, value_counts

# Below this many distinct values a numeric column is listed by value.
FEW_VALUES = 50


def basic_info(df: DataFrame, table_name: str, target: str | None = None) -> DataFrame:
    """One row per column with its type and kind, and the size of the table."""
    spark = df.sparkSession
    rows = [
        (table_name, i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    described = spark.createDataFrame(
        rows, "table_name string, ordinal int, column string, dtype string, kind string"
    )
    n_features = len(rows) - (1 if target else 0)
    return described.select(
        "*",
        row_count(df).alias("n_rows"),
        F.lit(len(rows)).cast("bigint").alias("n_columns"),
        F.lit(n_features).cast("bigint").alias("n_features"),
    )


def _dtype_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString()) for c in columns], "column string, dtype string"
    )


def column_preview(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Type, distinct and null counts per column; min, max and mean where numeric."""
    names = flat_columns(df) if columns is None else list(columns)
    return _preview(df, names, column_facts(df, names))


def _preview(df: DataFrame, names: list[str], facts: DataFrame) -> DataFrame:
    return _dtype_table(df, names).join(facts, "column", "left").select(
        "column", "dtype", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), F.coalesce("n_null", F.lit(0)).alias("n_null"), "min", "max", "mean"
    )


def sample_values(df: DataFrame, k: int = 5, columns: Iterable[str] | None = None) -> DataFrame:
    """The k smallest distinct values per column, numbers by size and texts by letters
    (a table has no first rows in Spark). Tasks keep k values a column before the shuffle."""
    names = flat_columns(df) if columns is None else list(columns)
    return leading_values(df, names, k, smallest=True)[0].select("column", "rank", "value")


def top_text_values(df: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent values of every text column."""
    return leading_values(df, string_columns(df), k)[0]


def sensitive_column(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Distribution of one column: its k top values, or moments if numeric with many values.

    ``imbalance_ratio`` divides the largest by the smallest *rounded* share; it is
    1 for a single value and null where the smallest share rounds to zero.
    """
    counts = value_counts(df, [column]).persist()
    listed = column in string_columns(df) or counts.limit(FEW_VALUES).count() < FEW_VALUES
    if not listed:
        x = number(df, column)
        return df.agg(
            F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
        )
    share = F.round("pct", 2)
    extremes = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"), F.max(share).alias("hi"), F.min(share).alias("lo")
    )
    return (
        top_values(counts, k)
        .join(F.broadcast(extremes), "column")
        .select(
            "value", "n", "pct",
            F.when(F.col("k") > 1, ratio(F.col("hi"), F.col("lo"))).otherwise(1.0).alias("imbalance_ratio"),
        )
    )


def column_catalog(df: DataFrame, k: int = 5) -> DataFrame:
    """Per column: type, distinct and null counts, and its top values where few or text.

    A column that is numeric with many distinct values keeps one row without values.
    """
    names = flat_columns(df)
    text = string_columns(df)
    top, facts = leading_values(df, names, k, facts=True)
    facts = _preview(df, names, facts).select("column", "dtype", "n_unique", "n_null")
    return (
        facts.join(top, "column", "left")
        .withColumn("shown", F.col("column").isin(text) | (F.col("n_unique") < FEW_VALUES))
        .where(F.col("shown") | (F.coalesce("rank", F.lit(1)) == 1))
        .select(
            "column", "dtype", "n_unique", "n_null",
            *[F.when(F.col("shown"), F.col(c)).alias(c) for c in ("rank", "value", "n", "pct")],
        )
    )


def column_summary(df: DataFrame, k: int = 3, samples: int = 5) -> DataFrame:
    """One line per column: name, type, distinct count and its leading values.

    Text and low-cardinality columns show ``value(pct%)``; others sample values.
    """
    catalog = column_catalog(df, k)
    shown = catalog.where(F.col("rank").isNotNull()).groupBy("column").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "pct"))),
                lambda v: F.format_string("%s(%.2f%%)", v["value"], v["pct"]),
            ),
            ", ",
        ).alias("top")
    )
    sampled = sample_values(df, samples).groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]), ", ").alias("some")
    )
    facts = catalog.select("column", "dtype", "n_unique").distinct()
    return (
        facts.join(shown, "column", "left")
        .join(sampled, "column", "left")
        .select("column", "dtype", "n_unique", F.coalesce("top", "some", F.lit("")).alias("summary"))
    )


def numeric_stats(df: DataFrame, target: str | None = None, direct_rows: int | None = None) -> DataFrame:
    """Mean, sample std, extremes, exact median, corrected skew and kurtosis, distinct count."""
    names = numeric_columns(df, exclude=[target] if target else [])
    limits = {} if direct_rows is None else {"direct_rows": direct_rows}
    medians = quantile_frame(df, exact_quantiles(df, names, [0.5], **limits), ["median"])
    facts = column_facts(df, names, moments=True).withColumn("n", F.col("n_rows") - F.col("n_null"))
    return facts.join(F.broadcast(medians), "column", "left").select(
        "column", "n", "mean", "std", "min", "max", "median",
        sample_skewness(F.col("g1"), F.col("n")).alias("skew"),
        sample_kurtosis(F.col("g2"), F.col("n")).alias("kurt"),
        "n_unique",
    )


def categorical_stats(df: DataFrame, target: str | None = None) -> DataFrame:
    """Distinct count and Shannon entropy in nats of every text column."""
    names = string_columns(df, exclude=[target] if target else [])
    counts = keyed_counts(df, names).where(F.col("text").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_all"))
    p = F.col("n") / F.col("n_all")
    return (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_unique"), (-F.sum(p * F.ln(p))).alias("entropy"))
    )


def auto_profile(df: DataFrame) -> DataFrame:
    """A fuller profile of all columns: missing, distinct, moments, zeros."""
    names = flat_columns(df)
    shown = {"numeric": "Numeric", "categorical": "Categorical", "temporal": "DateTime"}
    types = df.sparkSession.createDataFrame(
        [(c, shown[kind_of(df.schema[c].dataType)]) for c in names], "column string, type string"
    )
    facts = column_facts(df, names, moments=True).withColumnRenamed("n_unique", "n_distinct")
    joined = types.join(facts, "column", "left")
    n_distinct = F.coalesce("n_distinct", F.lit(0))
    return joined.select(
        "column", "type", F.coalesce("n_null", F.lit(0)).alias("n_missing"),
        ratio(F.col("n_null"), F.col("n_rows")).alias("p_missing"),
        n_distinct.alias("n_distinct"),
        ((n_distinct > 0) & (n_distinct == F.col("n_rows") - F.col("n_null"))).alias("is_unique"),
        "mean", "std", "min", "max", "n_zeros",
        F.when(F.col("type") == "Categorical", F.coalesce("n_single", F.lit(0))).alias("n_categories"),
    )
