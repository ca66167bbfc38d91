"""Classifier metrics on a table that holds actual and predicted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import col
from auditloom.functions.numbers import ratio, zero_if_undefined
from auditloom.operators.counts import cell_rows, group_label, joint_counts, long_groups

# An error rate ratio above this is called significant.
SIGNIFICANT_RATIO = 1.25


def _outcomes(actual: str, predicted: str) -> Column:
    """A cell (actual, predicted, n) seen from its actual and from its predicted label."""
    y, p, n = col(actual).cast("string"), col(predicted).cast("string"), F.col("n")
    zero = F.lit(0).cast("bigint")
    return F.array(
        F.struct(y.alias("label"), n.alias("actual"), zero.alias("predicted"), F.when(y == p, n).otherwise(zero).alias("hit")),
        F.struct(p.alias("label"), zero.alias("actual"), n.alias("predicted"), zero.alias("hit")),
    )


def _f1() -> Column:
    return zero_if_undefined(2 * F.col("hit"), F.col("actual") + F.col("predicted"))


def _labels(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    cells = joint_counts(df, [actual, predicted])
    return (
        cells.select(F.inline(_outcomes(actual, predicted)))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for the combinations that occur."""
    return joint_counts(df, [actual, predicted]).select(
        col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted"), "n"
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label; labels of either side count."""
    return _labels(df, actual, predicted).select(
        "label",
        zero_if_undefined(F.col("hit"), F.col("predicted")).alias("precision"),
        zero_if_undefined(F.col("hit"), F.col("actual")).alias("recall"),
        _f1().alias("f1"),
        F.col("actual").alias("support"),
    )


def classification_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1 in one row."""
    return _labels(df, actual, predicted).agg(
        zero_if_undefined(F.sum("hit"), F.sum("actual")).alias("accuracy"),
        F.avg(_f1()).alias("f1_macro"),
        zero_if_undefined(F.sum(_f1() * F.col("actual")), F.sum("actual")).alias("f1_weighted"),
    )


def positive_label(cells: DataFrame, actual: str) -> Column:
    """The second label in text order, or the only one."""
    labels = cells.groupBy(col(actual).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).where("l is not null")
    return labels.orderBy("l").limit(2).agg(F.max("l")).scalar()


def group_metrics(
    df: DataFrame,
    groupings: Sequence[str] | Sequence[Sequence[str]],
    actual: str,
    predicted: str,
    positive: str | None = None,
) -> DataFrame:
    """Accuracy, F1, rates and confusion counts of every group.

    ``groupings`` lists columns, or tuples of columns for intersections. A null
    group is called ``Missing``. The positive class is ``positive``, by default the
    second label in text order of the whole frame. Groups are counted by (attribute,
    group, label) alone, combined in each task.
    """
    groups = [[g] if isinstance(g, str) else list(g) for g in groupings]
    cells = cell_rows(df, [c for g in groups for c in g] + [actual, predicted])
    chosen = F.lit(positive) if positive is not None else positive_label(cells, actual)
    labels = (
        long_groups(cells, groups, [actual, predicted, "n"], null_label="Missing")
        .select("attr", "key", F.inline(_outcomes(actual, predicted)))
        .groupBy("attr", "key", "label")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
        .withColumn("pos", F.col("label") == chosen)
    )
    of_positive = lambda c: F.coalesce(F.sum(F.when(F.col("pos"), F.col(c))), F.lit(0))
    sums = labels.groupBy("attr", "key").agg(
        F.sum("actual").alias("n"), F.sum("hit").alias("hits"), F.avg(_f1()).alias("f1_macro"),
        of_positive("actual").alias("p"), of_positive("predicted").alias("pp"), of_positive("hit").alias("tp"),
    )
    fp, fn = F.col("pp") - F.col("tp"), F.col("p") - F.col("tp")
    tn = F.col("n") - F.col("p") - fp
    return sums.select(
        "attr", group_label(F.col("key")).alias("grp"), "n",
        ratio(F.col("hits"), F.col("n")).alias("accuracy"), "f1_macro",
        ratio(F.col("pp"), F.col("n")).alias("selection_rate"), ratio(F.col("p"), F.col("n")).alias("base_rate"),
        "tp", fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        zero_if_undefined(F.col("tp"), F.col("p")).alias("tpr"),
        zero_if_undefined(tn, tn + fp).alias("tnr"),
        zero_if_undefined(fp, tn + fp).alias("fpr"),
        zero_if_undefined(fn, F.col("p")).alias("fnr"),
    )


def prediction_parity(groups: DataFrame) -> DataFrame:
    """Per attribute: spread of selection rates and disparate impact.

    The impact divides the smallest *non-zero* rate by the largest, 0 if there is none.
    """
    rate = F.col("selection_rate")
    return groups.groupBy("attr").agg(
        (F.max(rate) - F.min(rate)).alias("spd"),
        F.coalesce(ratio(F.min(F.when(rate > 0, rate)), F.max(rate)), F.lit(0.0)).alias("di"),
        F.min_by("grp", F.struct((-rate).alias("r"), F.col("grp").alias("g"))).alias("max_grp"),
        F.min_by("grp", F.struct(rate.alias("r"), F.col("grp").alias("g"))).alias("min_grp"),
    )


def error_rate_ratios(groups: DataFrame) -> DataFrame:
    """Per attribute with several groups: ratio of false negative rates, range of F1."""
    fnr = F.when((F.count(F.lit(1)) > 1) & (F.min("fnr") > 0), ratio(F.max("fnr"), F.min("fnr")))
    return groups.groupBy("attr").agg(
        fnr.alias("fnr_ratio"), F.min("f1_macro").alias("f1_min"), F.max("f1_macro").alias("f1_max"),
        ratio(F.max("f1_macro"), F.min("f1_macro")).alias("f1_ratio"),
        F.coalesce(fnr > SIGNIFICANT_RATIO, F.lit(False)).alias("significant"),
    )
