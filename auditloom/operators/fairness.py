"""Outcome rates by group and by intersection of groups, straight from the data.

Every function starts from the joint counts of the sensitive columns and the
target. That one aggregation is as large as the number of value combinations; pass
``cells`` to share it between several reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.columns import col, kind_of, value
from auditloom.functions.numbers import pct, ratio
from auditloom.operators.counts import cell_rows, group_label, long_groups

# Parity levels, the four-fifths rule, and bucket limits.
FAIR_BELOW = 0.1
MINOR_BELOW = 0.2
IMPACT_LOW, IMPACT_HIGH = 0.8, 1.25
IMPACT_OK = "ACCEPTABLE (80% rule satisfied)"
IMPACT_BAD = "CONCERNING (violates 80% rule)"
HIGH_SHARE, MEDIUM_SHARE = 0.1, 0.01

Pair = tuple[str, str]


def without_target(sensitive: Sequence[str], target: str | None) -> list[str]:
    """The sensitive columns in order, once each, never the target itself."""
    return [c for c in dict.fromkeys(sensitive) if c != target]


def pairs(df: DataFrame, sensitive: Sequence[str], selected: Sequence[Pair] | None = None) -> list[Pair]:
    """The selected pairs whose columns exist, else all pairs; none below two columns."""
    if len(sensitive) < 2:
        return []
    if selected:
        return [(a, b) for a, b in selected if a in df.columns and b in df.columns]
    return list(combinations(sensitive, 2))


def _label(target: str) -> Column:
    return col(target).cast("string").alias("label")


def _groups(df: DataFrame, groupings, target: str, cells: DataFrame | None, null_label: str | None) -> DataFrame:
    """(attr, key, label, n) for single columns and combinations alike."""
    if cells is None:
        cells = cell_rows(df, [c for g in groupings for c in g] + [target])
    return (
        long_groups(cells, groupings, [target, "n"], null_label)
        .groupBy("attr", "key", _label(target))
        .agg(F.sum("n").alias("n"))
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(attr, value, n, pct) of the target."""
    return group_proportions(df, [target])


def group_proportions(df: DataFrame, sensitive: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """(attr, value, n, pct) of every sensitive column, over all rows of the table."""
    return _proportions(df, [[c] for c in sensitive], cells)


def pair_proportions(df: DataFrame, column_pairs: Sequence[Pair], cells: DataFrame | None = None) -> DataFrame:
    """The same for intersections; the value is the joined label of the pair."""
    return _proportions(df, [list(p) for p in column_pairs], cells)


def _proportions(df: DataFrame, groupings, cells: DataFrame | None) -> DataFrame:
    if cells is None:
        cells = cell_rows(df, [c for g in groupings for c in g])
    counts = long_groups(cells, groupings, ["n"]).groupBy("attr", "key").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n")).scalar()
    return counts.select("attr", group_label(F.col("key")).alias("value"), "n", pct(F.col("n"), total).alias("pct"))


def _rates(df: DataFrame, groupings, target: str, cells: DataFrame | None, null_label: str | None) -> DataFrame:
    counts = _groups(df, groupings, target, cells, null_label)
    # a window partition holds one group's labels: as many rows as there are classes
    n_group = F.sum("n").over(W.partitionBy("attr", "key"))
    return counts.where(F.col("label").isNotNull()).select(
        "attr", "key", "label", "n", n_group.alias("n_group")
    ).withColumn("pct", pct(F.col("n"), F.col("n_group")))


def target_rates_by_group(df: DataFrame, sensitive: Sequence[str], target: str, cells: DataFrame | None = None) -> DataFrame:
    """(attr, grp, label, n, n_group, pct): the target's distribution inside each group."""
    rates = _rates(df, [[c] for c in sensitive], target, cells, None)
    return rates.select("attr", group_label(F.col("key")).alias("grp"), "label", "n", "n_group", "pct")


def intersectional_rates(df: DataFrame, column_pairs: Sequence[Pair], target: str, cells: DataFrame | None = None) -> DataFrame:
    """The same for every pair of sensitive columns. Pairs are grouped as pairs, so
    ('x_y', 'z') and ('x', 'y_z') stay apart although their labels look alike."""
    rates = _rates(df, [list(p) for p in column_pairs], target, cells, None)
    return rates.select("attr", group_label(F.col("key")).alias("grp"), "label", "n", "n_group", "pct")


def scale_buckets(df: DataFrame, column_pairs: Sequence[Pair], cells: DataFrame | None = None) -> DataFrame:
    """(attr, grp, n, bucket): each combination's size against the pair's largest."""
    groupings = [list(p) for p in column_pairs]
    if cells is None:
        cells = cell_rows(df, [c for g in groupings for c in g])
    counts = long_groups(cells, groupings, ["n"]).groupBy("attr", "key").agg(F.sum("n").alias("n"))
    largest = counts.groupBy("attr").agg(F.max("n").alias("largest"))
    bucket = (
        F.when(F.col("n") >= F.col("largest") * HIGH_SHARE, "high")
        .when(F.col("n") >= F.col("largest") * MEDIUM_SHARE, "medium")
        .otherwise("low")
    )
    return counts.join(F.broadcast(largest), "attr").select(
        "attr", group_label(F.col("key")).alias("grp"), "n", bucket.alias("bucket")
    )


def bucket_ranges(buckets: DataFrame) -> DataFrame:
    """(attr, bucket, n_groups, range): the sizes a bucket spans, as ``min-max``."""
    return buckets.groupBy("attr", "bucket").agg(
        F.count(F.lit(1)).alias("n_groups"), F.format_string("%d-%d", F.min("n"), F.max("n")).alias("range")
    )


def top_combinations(df: DataFrame, column_pairs: Sequence[Pair], target: str, k: int = 50, cells: DataFrame | None = None) -> DataFrame:
    """The k largest combinations of each pair with their target distribution."""
    rates = _rates(df, [list(p) for p in column_pairs], target, cells, None)
    sizes = rates.groupBy("attr", "key").agg(F.first("n_group").alias("size"))
    order = W.partitionBy("attr").orderBy(F.col("size").desc(), group_label(F.col("key")), "key")
    # k groups a pair are left before their labels are looked up
    largest = sizes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("attr", "key")
    return rates.join(F.broadcast(largest), ["attr", "key"]).select(
        "attr", group_label(F.col("key")).alias("grp"), "label", "n", "n_group", "pct"
    )


def modal_rate_parity(df: DataFrame, sensitive: Sequence[str], target: str, cells: DataFrame | None = None) -> DataFrame:
    """Spread of the groups' largest class shares, whichever class that is in each group."""
    modal = (
        _rates(df, [[c] for c in sensitive], target, cells, None)
        .groupBy("attr", "key")
        .agg(F.max(ratio(F.col("n"), F.col("n_group"))).alias("rate"))
    )
    spread = modal.groupBy("attr").agg(
        F.count(F.lit(1)).alias("n_groups"), F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate")
    ).where(F.col("n_groups") >= 2)
    disparity = F.col("max_rate") - F.col("min_rate")
    level = F.when(disparity < FAIR_BELOW, "FAIR").when(disparity < MINOR_BELOW, "MINOR_DISPARITY").otherwise("SIGNIFICANT_DISPARITY")
    return spread.select("attr", "n_groups", "max_rate", "min_rate", disparity.alias("disparity"), level.alias("level"))


def modal_group_rates(df: DataFrame, sensitive: Sequence[str], target: str, cells: DataFrame | None = None) -> DataFrame:
    """(attr, grp, n_group, rate): what :func:`modal_rate_parity` compares."""
    rates = _rates(df, [[c] for c in sensitive], target, cells, None)
    return rates.groupBy("attr", "key").agg(
        F.first("n_group").alias("n_group"), F.max(ratio(F.col("n"), F.col("n_group"))).alias("rate")
    ).select("attr", group_label(F.col("key")).alias("grp"), "n_group", "rate")


def binary_parity(
    df: DataFrame,
    sensitive: Sequence[str],
    target: str,
    privileged: dict[str, tuple[str, str]] | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Disparate impact and parity difference of a two-valued target.

    The favourable label is the larger of the two. The unprivileged group is the
    first in order and the privileged one the second, unless ``privileged`` names
    them per column as (privileged, unprivileged). Other targets give no rows.
    """
    if cells is None:
        cells = cell_rows(df, list(sensitive) + [target])
    privileged = privileged or {}
    y = col(target)
    labels = cells.agg(
        F.when((F.count_distinct(y) == 2) & (F.count_if(y.isNull()) == 0), F.max(y)).alias("favourable")
    )
    favourable = labels.scalar()
    entries = []
    for c in sensitive:
        dtype = df.schema[c].dataType
        order = col(c).cast("double") if kind_of(dtype) == "numeric" else F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(c).alias("attr"),
                F.coalesce(col(c).cast("string"), F.lit("Unknown")).alias("grp"),
                order.alias("order"),
            )
        )
    groups = (
        cells.select(F.inline(F.array(*entries)), (y == favourable).alias("fav"), "n")
        .where(F.col("fav").isNotNull())
        .groupBy("attr", "grp", "order")
        .agg(ratio(F.sum(F.when(F.col("fav"), F.col("n")).otherwise(0)), F.sum("n")).alias("base"))
    )
    # attributes without named groups: the first two in order; Spark limits before the shuffle
    place = F.row_number().over(W.partitionBy("attr").orderBy(F.col("order").asc_nulls_last(), "grp"))
    roles = (
        groups.where(~F.col("attr").isin(list(privileged)) if privileged else F.lit(True))
        .withColumn("place", place)
        .where(F.col("place") <= 2)
        .select("attr", "grp", "base", F.when(F.col("place") == 1, "unpriv").otherwise("priv").alias("role"))
    )
    for c, (priv, unpriv) in privileged.items():
        named = groups.where((F.col("attr") == c) & F.col("grp").isin(priv, unpriv))
        roles = roles.unionByName(
            named.select("attr", "grp", "base", F.when(F.col("grp") == priv, "priv").otherwise("unpriv").alias("role"))
        )
    pick = lambda name, what: F.max(F.when(F.col("role") == name, F.col(what)))
    wide = roles.groupBy("attr").agg(
        pick("priv", "grp").alias("priv"), pick("unpriv", "grp").alias("unpriv"),
        pick("priv", "base").alias("base_priv"), pick("unpriv", "base").alias("base_unpriv"),
    ).where(F.col("priv").isNotNull() & F.col("unpriv").isNotNull())
    di = ratio(F.col("base_unpriv"), F.col("base_priv"))
    return wide.select(
        "attr", "priv", "unpriv", "base_priv", "base_unpriv", di.alias("di"),
        (F.col("base_unpriv") - F.col("base_priv")).alias("spd"),
        F.when((di >= IMPACT_LOW) & (di <= IMPACT_HIGH), IMPACT_OK).otherwise(IMPACT_BAD).alias("status"),
    )


def combine_columns(df: DataFrame, columns: Sequence[str], name: str = "combined_group") -> DataFrame:
    """Adds the columns' values joined by '_'; a null shows as ``nan``."""
    parts = [F.coalesce(value(df, c).cast("string"), F.lit("nan")) for c in columns]
    return df.withColumn(name, F.concat_ws("_", *parts))
