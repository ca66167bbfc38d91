"""A table before and after a treatment: size, classes, groups, balance, fairness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import row_count
from auditloom.functions.numbers import pct, ratio
from auditloom.operators.counts import value_counts
from auditloom.operators.resample import WEIGHT, class_counts, weighted_distribution

# Shares of improved metrics that name the overall effect.
SIGNIFICANT, MODERATE = 0.6, 0.3


def compare_size(original: DataFrame, mitigated: DataFrame) -> DataFrame:
    counts = original.agg(F.count(F.lit(1)).alias("n_orig")).select("n_orig", row_count(mitigated).alias("n_mit"))
    return counts.select(
        "n_orig", "n_mit", (F.col("n_mit") - F.col("n_orig")).alias("difference"),
        pct(F.col("n_mit") - F.col("n_orig"), F.col("n_orig")).alias("pct_change"),
    )


def _class_table(original: DataFrame, after: DataFrame, n_after: str, total_orig: Column, total_mit: Column) -> DataFrame:
    n_mit = F.coalesce(F.col(n_after), F.lit(0))
    pct_orig, pct_mit = pct(F.col("n"), total_orig), F.coalesce(pct(n_mit, total_mit), F.lit(0.0))
    return original.join(after, "label", "left").select(
        "label", F.col("n").alias("n_orig"), pct_orig.alias("pct_orig"), n_mit.alias("n_mit"), pct_mit.alias("pct_mit"),
        (n_mit - F.col("n")).alias("change"), (pct_mit - pct_orig).alias("pp_change"),
    )


def compare_target(original: DataFrame, mitigated: DataFrame, target: str) -> DataFrame:
    """Per class of the original: counts and shares of all rows, before and after."""
    after = class_counts(mitigated, target).withColumnRenamed("n", "n_after")
    return _class_table(class_counts(original, target), after, "n_after", row_count(original), row_count(mitigated))


def compare_target_weighted(original: DataFrame, weighted: DataFrame, target: str) -> DataFrame:
    """The same with summed weights, and shares of the total weight, on the right side."""
    after = weighted_distribution(weighted, target).select("label", "weighted_n")
    total = after.agg(F.sum("weighted_n")).scalar()
    return _class_table(class_counts(original, target), after, "weighted_n", row_count(original), total)


def compare_sensitive(original: DataFrame, mitigated: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Per value of each sensitive column in both tables: rows before and after, unweighted."""
    shared = [c for c in sensitive if c in original.columns and c in mitigated.columns]
    before = value_counts(original, shared).select(F.col("column").alias("attr"), "value", F.col("n").alias("a"), F.col("pct").alias("pa"))
    after = value_counts(mitigated, shared).select(F.col("column").alias("attr"), "value", F.col("n").alias("b"), F.col("pct").alias("pb"))
    zero = F.lit(0)
    return before.join(after, ["attr", "value"], "full").select(
        "attr", "value", F.coalesce("a", zero).alias("n_orig"), F.coalesce("pa", F.lit(0.0)).alias("pct_orig"),
        F.coalesce("b", zero).alias("n_mit"), F.coalesce("pb", F.lit(0.0)).alias("pct_mit"),
        (F.coalesce("b", zero) - F.coalesce("a", zero)).alias("change"),
    )


def _spread(sizes: DataFrame, n: str) -> Column:
    return sizes.agg(F.when(F.min(n) > 0, ratio(F.max(n), F.min(n))).otherwise(0.0)).scalar()


def compare_imbalance(original: DataFrame, mitigated: DataFrame, target: str, method: str) -> DataFrame:
    """(method, rows, ratio_orig, ratio_mit, improved); weights count where there are any."""
    if WEIGHT in mitigated.columns:
        after = _spread(weighted_distribution(mitigated, target), "weighted_n")
    else:
        after = _spread(class_counts(mitigated, target), "n")
    return compare_size(original, mitigated).select(
        F.lit(method).alias("method"), F.col("n_orig").alias("rows_orig"), F.col("n_mit").alias("rows_mit"),
        _spread(class_counts(original, target), "n").alias("ratio_orig"), after.alias("ratio_mit"),
    ).withColumn("improved", F.col("ratio_mit") < F.col("ratio_orig"))


def rank_methods(rows: Sequence[DataFrame]) -> DataFrame:
    """All methods with their rank: lowest ratio first, earlier methods first among equals."""
    from pyspark.sql import Window as W

    placed = reduce(DataFrame.unionByName, [r.withColumn("place", F.lit(i)) for i, r in enumerate(rows)])
    # one row per method, so a single window partition is a handful of rows
    order = W.partitionBy(F.lit(1)).orderBy("ratio_mit", "place")
    return placed.withColumn("rank", F.row_number().over(order)).drop("place")


def compare_fairness(base: DataFrame, mitigated: DataFrame) -> DataFrame:
    """Per attribute in both parity tables: did the difference shrink, did the impact near 1."""
    b = base.select("attr", F.col("spd").alias("spd_base"), F.col("di").alias("di_base"))
    m = mitigated.select("attr", F.col("spd").alias("spd_mit"), F.col("di").alias("di_mit"))
    return b.join(m, "attr").select(
        "attr", "spd_base", "spd_mit", (F.col("spd_base") - F.col("spd_mit")).alias("spd_change"),
        (F.abs("spd_mit") < F.abs("spd_base")).alias("spd_improved"),
        "di_base", "di_mit", (F.col("di_mit") - F.col("di_base")).alias("di_change"),
        (F.abs(F.col("di_mit") - 1.0) < F.abs(F.col("di_base") - 1.0)).alias("di_improved"),
    )


def fairness_effect(comparison: DataFrame, total: str = "attributes") -> DataFrame:
    """One row naming the overall effect.

    By default an attribute counts once if either metric improved, against two
    metrics per attribute, so the share cannot exceed one half and the strongest
    name is out of reach. ``total="metrics"`` counts every improved metric.
    """
    spd, di = F.col("spd_improved"), F.col("di_improved")
    improved = spd.cast("int") + di.cast("int") if total == "metrics" else (spd | di).cast("int")
    share = F.coalesce(ratio(F.sum(improved), F.count(F.lit(1)) * 2), F.lit(0.0))
    return comparison.agg(
        F.coalesce(F.sum(improved), F.lit(0)).cast("bigint").alias("n_improved"),
        F.when(share > SIGNIFICANT, "Significant")
        .when(share > MODERATE, "Moderate")
        .when(share > 0, "Minor")
        .otherwise("None or Negative")
        .alias("overall"),
    )
