"""Class balance and dominant values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import string_columns, value
from auditloom.functions.numbers import ratio
from auditloom.operators.counts import leading_values

# Imbalance levels by the ratio of largest to smallest class.
LEVELS = [
    (1.5, "BALANCED", "Classes are well balanced."),
    (3.0, "SLIGHTLY_IMBALANCED", "Minor imbalance. Consider stratified sampling."),
    (10.0, "IMBALANCED", "Significant imbalance. Use SMOTE, class weights, or oversampling."),
]
WORST_LEVEL = (
    "HIGHLY_IMBALANCED",
    "CRITICAL: Severe class imbalance. Use advanced techniques (ADASYN, focal loss).",
)
DOMINANT_PCT = 65.0


def _by_level(r: Column, part: int) -> Column:
    out = F.when(r < LEVELS[0][0], LEVELS[0][1 + part])
    for level in LEVELS[1:]:
        out = out.when(r < level[0], level[1 + part])
    return out.otherwise(WORST_LEVEL[part])


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class, the max/min ratio and its level; nulls are left out."""
    counts = (
        df.select(value(df, target).cast("string").alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.agg(
        F.sum("n").alias("n_all"),
        F.when(F.count(F.lit(1)) >= 2, ratio(F.max("n"), F.min("n"))).otherwise(1.0).alias("ratio"),
    ).select(F.struct("n_all", "ratio")).scalar()
    r = F.col("t")["ratio"]
    return counts.withColumn("t", totals).select(
        "label", "n", ratio(F.col("n"), F.col("t")["n_all"]).alias("share"), r.alias("ratio"),
        _by_level(r, 0).alias("status"), _by_level(r, 1).alias("advice"),
    )


def dominant_values(df: DataFrame, sensitive: Iterable[str] | None = None, k: int = 5) -> DataFrame:
    """Text columns whose top value has a rounded share above 65 %, with their top values."""
    names = string_columns(df)
    if sensitive is not None:
        wanted = set(sensitive)
        names = [c for c in names if c in wanted]
    top, _ = leading_values(df, names, k)
    flagged = top.where((F.col("rank") == 1) & (F.round("pct", 2) > DOMINANT_PCT)).select("column")
    return top.join(F.broadcast(flagged), "column", "left_semi").select(
        "column", F.col("rank"), "value", F.round("pct", 2).alias("pct")
    )
