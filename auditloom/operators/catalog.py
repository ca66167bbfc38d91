"""Guesses from column names, over a catalog of (table_name, ordinal, column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.columns import col, flat_columns, kind_of, value
from auditloom.operators.counts import distinct_counts

# Names that mark targets, sensitive attributes and dates.
TARGET_NAMES = [
    "target", "label", "class", "outcome", "y", "income", "churn", "default", "fraud", "diagnosis",
]
SENSITIVE_WORDS = [
    "sex", "gender", "race", "ethnicity", "age", "religion", "nationality", "disability",
    "sexual_orientation", "marital",
]
CATEGORY_WORDS = {
    "personal_identifiers": ["id", "name", "email", "phone", "ssn", "address", "zip"],
    "protected_attributes": [
        "race", "gender", "sex", "age", "religion", "disability", "nationality", "ethnicity",
        "sexual_orientation",
    ],
    "financial": ["salary", "income", "credit", "loan", "debt"],
    "health": ["disease", "diagnosis", "medical", "health", "symptom", "medication"],
}
TEMPORAL_WORDS = ["date", "time", "year"]
PRIVACY_WARNING = (
    "PRIVACY WARNING: Sensitive attributes detected. Ensure proper anonymization and "
    "compliance with regulations (GDPR, HIPAA, etc.)"
)


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column, from the schemas alone."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column string, dtype string, kind string"
    )


def _has_any(words: list[str]):
    return F.lower("column").rlike("|".join(words))


def guess_target(catalog: DataFrame) -> DataFrame:
    """The first column with a usual target name, else the last column, per table."""
    named = F.lower("column").isin(TARGET_NAMES)
    return catalog.groupBy("table_name").agg(
        F.coalesce(
            F.min_by("column", F.when(named, F.col("ordinal"))), F.max_by("column", "ordinal")
        ).alias("column")
    )


def sensitive_by_keyword(catalog: DataFrame) -> DataFrame:
    """Columns whose name contains a sensitive word anywhere, so ``page`` matches ``age``."""
    return catalog.where(_has_any(SENSITIVE_WORDS)).select("table_name", "column")


def sensitive_by_category(catalog: DataFrame) -> DataFrame:
    """(table_name, column, category); a column may fall into several categories."""
    hits = F.array_compact(
        F.array(*[F.when(_has_any(words), F.lit(name)) for name, words in CATEGORY_WORDS.items()])
    )
    return catalog.select("table_name", "column", F.explode(hits).alias("category"))


def privacy_warning(catalog: DataFrame) -> DataFrame:
    """Per table with any sensitive column: how many, and the warning text."""
    return sensitive_by_category(catalog).groupBy("table_name").agg(
        F.count_distinct("column").alias("n_columns"), F.lit(PRIVACY_WARNING).alias("warning")
    )


def temporal_columns(catalog: DataFrame, by_type: bool = False) -> DataFrame:
    """Columns whose name speaks of a date; ``by_type`` adds date and timestamp columns."""
    hit = _has_any(TEMPORAL_WORDS)
    if by_type:
        hit = hit | (F.col("kind") == "temporal")
    return catalog.where(hit).select("table_name", "column")


def flagged_column_facts(tables: dict[str, DataFrame], flagged: DataFrame) -> DataFrame:
    """Adds to (table_name, column, ...) what the data says: rows, nulls, distinct values.

    One job per table that has a flagged column, over just those columns. A nested
    column has rows and nulls, but no distinct values.
    """
    wanted: dict[str, list[str]] = {}
    for row in flagged.select("table_name", "column").distinct().collect():
        wanted.setdefault(row["table_name"], []).append(row["column"])
    parts = []
    for name in sorted(wanted):
        df = tables[name]
        flat = set(flat_columns(df))
        columns = sorted(wanted[name])
        entries = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n_rows"), F.count_if((value(df, c) if c in flat else col(c)).isNull()).alias("n_null"),
            )
            for c in columns
        ]
        sizes = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
        parts.append(sizes.join(F.broadcast(distinct_counts(df, [c for c in columns if c in flat])), "column", "left"))
    out = flagged.limit(0).select("table_name", "column", *[F.lit(0).cast("bigint").alias(c) for c in ("n_rows", "n_null", "n_unique")])
    for p in parts:
        out = out.unionByName(p.select(*out.columns))
    return flagged.join(F.broadcast(out), ["table_name", "column"])
