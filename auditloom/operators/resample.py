"""Rebalancing a table: weights, oversampling, undersampling, synthetic minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import col, kind_of, number, value
from auditloom.functions.hashing import keyed_md5, unit_interval
from auditloom.functions.joins import join_lookup
from auditloom.functions.numbers import pct, ratio
from auditloom.functions.ranking import ordered_codes
from auditloom.operators.counts import joint_counts
from auditloom.operators.fairness import combine_columns
from auditloom.operators.neighbors import BLOCK_ROWS, nearest_neighbours
from auditloom.operators.sampling import (
    SEED,
    drawn_index,
    draws,
    lowest_by_hash,
    numbered_rows,
)

WEIGHT = "sample_weight"
GROUP = "combined_group"


# ------------------------------------------------------------------------ weights


def group_weights(df: DataFrame, target: str, sensitive: Sequence[str]) -> DataFrame:
    """(group columns, target, sample_weight): (rows of group / classes) / rows of group and class.

    That gives every class the same weight inside each group. With several columns
    a null is a group of its own; with one column null groups get no weight here.
    """
    cells = joint_counts(df, [*sensitive, target])
    if len(sensitive) == 1:
        cells = cells.where(col(sensitive[0]).isNotNull())
    sizes = cells.groupBy(*[col(c) for c in sensitive]).agg(F.sum("n").alias("n_group"))
    known = cells.where(col(target).isNotNull())
    n_classes = df.agg(F.count_distinct(value(df, target))).scalar()
    weights = known
    same = None
    for c in sensitive:
        sizes = sizes.withColumnRenamed(c, f"g_{c}")
        test = col(c).eqNullSafe(col(f"g_{c}"))
        same = test if same is None else same & test
    return weights.join(sizes, same).select(
        *[col(c) for c in sensitive], col(target),
        (ratio(F.col("n_group"), n_classes) / F.col("n")).alias(WEIGHT),
    )


def reweight(df: DataFrame, target: str, sensitive: Sequence[str]) -> DataFrame:
    """Adds ``sample_weight``; rows of a null group (one column) or null target weigh 1."""
    clean = df.select(*[value(df, c).alias(c) for c in df.columns])
    weighted = join_lookup(
        clean, group_weights(clean, target, sensitive), [*sensitive, target], "left", null_safe=len(sensitive) > 1
    )
    out = weighted.withColumn(WEIGHT, F.coalesce(WEIGHT, F.lit(1.0)))
    if len(sensitive) > 1:
        out = combine_columns(out, sensitive, GROUP)
        out = out.select(*[col(c) for c in df.columns], GROUP, WEIGHT)
    return out


def weight_stats(weighted: DataFrame) -> DataFrame:
    """Extremes, mean, median and population std, from counts of the distinct weights."""
    counts = weighted.groupBy(WEIGHT).agg(F.count(F.lit(1)).alias("n"))
    w, n = F.col(WEIGHT), F.col("n")
    mean = F.sum(w * n) / F.sum(n)
    centre = counts.agg(mean).scalar()
    return counts.agg(
        F.min(w).alias("min"), F.max(w).alias("max"), mean.alias("mean"),
        F.percentile(w, F.lit(0.5), n).alias("median"),
        F.sqrt(F.sum(n * (w - centre) * (w - centre)) / F.sum(n)).alias("std_pop"),
    )


def weighted_distribution(weighted: DataFrame, target: str) -> DataFrame:
    """(label, weighted_n, weighted_ratio): classes after weighting, and max / min of them."""
    sums = (
        weighted.where(value(weighted, target).isNotNull())
        .groupBy(col(target).cast("string").alias("label"))
        .agg(F.sum(WEIGHT).alias("weighted_n"))
    )
    spread = sums.agg(
        F.when(F.min("weighted_n") > 0, F.round(F.max("weighted_n") / F.min("weighted_n"), 2)).otherwise(0.0)
    ).scalar()
    return sums.withColumn("weighted_ratio", spread)


# ------------------------------------------------------------------------ the plan


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, n) of the non-null classes."""
    return (
        df.select(value(df, target).cast("string").alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sampling_plan(counts: DataFrame, strategy: str = "auto", direction: str = "over") -> DataFrame:
    """(label, n, target_n): the size every class should get.

    ``over`` raises classes to the largest, ``under`` lowers them to the smallest.
    Strategies: ``auto``, ``minority``, ``majority``, ``not minority``,
    ``not majority``, ``all``. Equal sizes are told apart by label.
    """
    if direction not in ("over", "under"):
        raise ValueError(f"unknown direction: {direction}")
    default = {"over": "not majority", "under": "not minority"}[direction]
    chosen = default if strategy == "auto" else strategy
    allowed = {"over": {"minority", "not minority", "not majority", "all"},
               "under": {"majority", "not minority", "not majority", "all"}}[direction]
    if chosen not in allowed:
        raise ValueError(f"strategy {strategy!r} does not fit {direction}-sampling")
    ends = counts.agg(
        F.min_by("label", F.struct("n", "label")).alias("minority"),
        F.min_by("label", F.struct((-F.col("n")).alias("m"), F.col("label"))).alias("majority"),
        F.min("n").alias("smallest"), F.max("n").alias("largest"),
    ).select(F.struct("*")).scalar()
    e = F.col("ends")
    is_min, is_max = F.col("label") == e["minority"], F.col("label") == e["majority"]
    applies = {"all": F.lit(True), "minority": is_min, "majority": is_max,
               "not minority": ~is_min, "not majority": ~is_max}[chosen]
    goal = e["largest"] if direction == "over" else e["smallest"]
    return counts.withColumn("ends", ends).select(
        "label", "n", F.when(applies, goal).otherwise(F.col("n")).cast("bigint").alias("target_n")
    )


# ---------------------------------------------------------------------- resampling


def oversample(df: DataFrame, key: Sequence[str], target: str, strategy: str = "auto", seed: int = SEED) -> DataFrame:
    """All rows, plus rows drawn with replacement until each class has its planned size.

    ``draw`` is null for the originals. Only classes that are raised get row numbers;
    draws meet rows in an equi-join on (class, number), which is spread evenly.
    """
    plan = sampling_plan(class_counts(df, target), strategy, "over").persist()
    raised = plan.where(F.col("target_n") > F.col("n")).select("label")
    label = value(df, target).cast("string")
    pool = numbered_rows(
        df.join(raised, label == F.col("label"), "left_semi"), target, key, seed
    )
    drawn = draws(plan).select(
        F.col("label").alias("__label"), "draw",
        drawn_index(F.col("label"), F.col("draw"), F.col("n"), seed).alias("rn"),
    )
    extra = drawn.join(pool, ["__label", "rn"]).select(*[col(c) for c in df.columns], "draw")
    return df.withColumn("draw", F.lit(None).cast("bigint")).unionByName(extra)


def undersample(df: DataFrame, key: Sequence[str], target: str, strategy: str = "auto", seed: int = SEED) -> DataFrame:
    """Exactly the planned number of rows per class, without replacement."""
    plan = sampling_plan(class_counts(df, target), strategy, "under")
    lowered = plan.where(F.col("target_n") < F.col("n")).select("label", "target_n")
    return lowest_by_hash(df, target, key, lowered, seed)


def synthetic_vectors(
    df: DataFrame,
    key: str,
    vector: str,
    target: str,
    k: int = 5,
    strategy: str = "auto",
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
    method: str = "exact",
) -> DataFrame:
    """(base_key, neighbour_key, draw, features, label): points between a row and a near one.

    Each draw takes a row of the class, one of its k nearest rows of the same class,
    and a place on the line between them.
    """
    plan = sampling_plan(class_counts(df, target), strategy, "over").persist()
    raised = plan.where(F.col("target_n") > F.col("n"))
    too_small = raised.where(F.col("n") <= k).select("label").limit(5).collect()
    if too_small:
        raise ValueError(f"classes with {k} rows or fewer have no {k} neighbours: {[r[0] for r in too_small]}")
    label = value(df, target).cast("string")
    pool = df.select(col(key).alias("id"), label.alias("y"), col(vector).cast("array<double>").alias("x")).join(
        raised.select("label"), F.col("y") == F.col("label"), "left_semi"
    )
    numbered = numbered_rows(pool, "y", ["id"], seed).select("__label", "rn", F.col("id").alias("base_key"), F.col("x").alias("a"))
    near = nearest_neighbours(pool, "id", "x", k, within="y", block_rows=block_rows, method=method).select(
        F.col("id").alias("base_key"), "rank", F.col("neighbour").alias("neighbour_key")
    )
    drawn = draws(plan).select(
        F.col("label").alias("__label"), "draw",
        drawn_index(F.col("label"), F.col("draw"), F.col("n"), seed, "row").alias("rn"),
        (drawn_index(F.col("label"), F.col("draw"), F.lit(k), seed, "neighbour") + 1).cast("int").alias("rank"),
        unit_interval(keyed_md5(str(seed), "place", F.col("label"), F.col("draw"))).alias("u"),
    )
    return (
        drawn.join(numbered, ["__label", "rn"])
        .join(near, ["base_key", "rank"])
        .join(pool.select(F.col("id").alias("neighbour_key"), F.col("x").alias("b")), "neighbour_key")
        .select(
            "base_key", "neighbour_key", "draw",
            F.zip_with("a", "b", lambda a, b: a + F.col("u") * (b - a)).alias("features"),
            F.col("__label").alias("label"),
        )
    )


def smote(
    df: DataFrame,
    key: str,
    target: str,
    k: int = 5,
    strategy: str = "auto",
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
    method: str = "exact",
) -> DataFrame:
    """The table with synthetic rows for the smaller classes; ``synthetic`` marks them.

    Text columns take part as alphabetical codes (null is -1) and are decoded from the
    rounded result; whole-number columns stay whole. A null number is an error. The
    key of a synthetic row is null; ``made_from`` tells it apart: base row, neighbour, draw
    and class. It is null for the given rows.
    """
    features = [c for c in df.columns if c not in (key, target)]
    clean = df.select(*[value(df, c).alias(c) for c in df.columns])
    text = [c for c in features if kind_of(df.schema[c].dataType) == "categorical"]
    other = [c for c in features if c not in text]
    bad = [c for c in other if kind_of(df.schema[c].dataType) != "numeric"]
    if bad:
        raise ValueError(f"columns of this type cannot be interpolated: {bad}")
    if other and clean.where(" or ".join(f"`{c}` is null" for c in other)).limit(1).count():
        raise ValueError("numeric columns must not hold nulls")

    books = ordered_codes(clean, text)
    coded = clean
    for i, c in enumerate(text):
        book, size = books[c]
        coded = coded.withColumn(c, col(c).cast("string"))
        coded = join_lookup(coded, book.select(F.col("value").alias(c), F.col("code").alias(f"__code_{i}")), [c], "left", n_rows=size)
    parts: list[Column] = [
        F.coalesce(F.col(f"__code_{text.index(c)}").cast("double"), F.lit(-1.0)) if c in text else number(df, c)
        for c in features
    ]
    points = coded.select(col(key), col(target), F.array(*parts).alias("__features"))
    made = synthetic_vectors(points, key, "__features", target, k, strategy, seed, block_rows, method)

    made_from = F.concat_ws("-", "base_key", "neighbour_key", "draw", "label").alias("made_from")
    new = made.select("label", made_from, *[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(features)])
    for c in text:
        book, size = books[c]
        new = new.withColumn("__c", F.rint(col(c)).cast("bigint")).drop(c)
        new = join_lookup(new, book.select(F.col("code").alias("__c"), F.col("value").alias(c)), ["__c"], "left", n_rows=size).drop("__c")
    new = new.select(
        *[
            F.lit(None).cast(df.schema[c].dataType).alias(c) if c == key
            else F.col("label").cast(df.schema[c].dataType).alias(c) if c == target
            else col(c).cast(df.schema[c].dataType).alias(c)
            for c in df.columns
        ],
        F.lit(True).alias("synthetic"), "made_from",
    )
    given = clean.withColumns({"synthetic": F.lit(False), "made_from": F.lit(None).cast("string")})
    return given.unionByName(new)


def mitigation_summary(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """(label, n_before, pct_before, n_after, pct_after, change) per class of either table."""
    a = class_counts(before, target).withColumnRenamed("n", "a")
    b = class_counts(after, target).withColumnRenamed("n", "b")
    total_a, total_b = a.agg(F.sum("a")).scalar(), b.agg(F.sum("b")).scalar()
    n_before, n_after = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, "label", "full").select(
        "label", n_before.alias("n_before"), pct(n_before, total_a).alias("pct_before"),
        n_after.alias("n_after"), pct(n_after, total_b).alias("pct_after"),
        (n_after - n_before).alias("change"),
    )
