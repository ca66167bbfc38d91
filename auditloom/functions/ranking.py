"""Running totals and dense codes over ordered values, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VALUES_PER_TASK = 500_000


def running_totals(
    counts: DataFrame,
    keys: list[str],
    value: str = "value",
    n: str = "n",
    values_per_task: int = VALUES_PER_TASK,
) -> DataFrame:
    """Add ``before``: the sum of ``n`` over all smaller values of the same key.

    ``counts`` holds one row per (key, value), so a frequent value is a single
    row. Up to ``values_per_task`` rows a plain window does it. Beyond that the
    values are cut into ranges at values picked by their hash; each range is its
    own window partition and starts from the total of the ranges before it.
    """
    counts = counts.persist()
    total = counts.count()
    ordered = F.col(value)
    if total <= values_per_task:
        before = F.sum(n).over(
            W.partitionBy(*keys).orderBy(ordered).rowsBetween(W.unboundedPreceding, -1)
        )
        return counts.withColumn("before", F.coalesce(before, F.lit(0)).cast("bigint"))

    every = values_per_task
    splits = (
        counts.where(F.pmod(F.xxhash64(*keys, value), F.lit(every)) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(value)).alias("splits"))
    )
    ranged = (
        counts.join(F.broadcast(splits), keys, "left")
        .withColumn(
            "range",
            F.coalesce(F.size(F.filter("splits", lambda s: s <= F.col(value))), F.lit(0)),
        )
        .drop("splits")
    )
    starts = (
        ranged.groupBy(*keys, "range")
        .agg(F.sum(n).alias("in_range"))
        .withColumn(
            "start",
            F.coalesce(
                F.sum("in_range").over(
                    W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("in_range")
    )
    local = F.sum(n).over(
        W.partitionBy(*keys, "range").orderBy(ordered).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("local", F.coalesce(local, F.lit(0)))
        .join(F.broadcast(starts), [*keys, "range"])
        .withColumn("before", (F.col("start") + F.col("local")).cast("bigint"))
        .drop("range", "start", "local")
    )


def ordered_codes(df: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, int]]:
    """Per column its code table (value, code) and the number of values.

    Codes number the distinct non-null texts from 0 in ascending order. All columns
    are coded by one job; a table is a slice of its persisted result.
    """
    if not columns:
        return {}
    cells = [e for c in columns for e in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    distinct = (
        df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .withColumn("n", F.lit(1).cast("bigint"))
    )
    codes = running_totals(distinct, ["column"]).select("column", "value", F.col("before").alias("code")).persist()
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: (codes.where(F.col("column") == c).select("value", "code"), sizes.get(c, 0)) for c in columns}
