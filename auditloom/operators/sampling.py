"""Deterministic row numbering, cut-offs and draws, spread over many tasks.

A row's place in its class is the order of md5(key, seed), so it is the same under
any partitioning. ``key`` must identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.columns import col
from auditloom.functions.hashing import hash_int, keyed_md5
from auditloom.functions.joins import join_lookup

SEED = 42
HEX_DIGITS = 4  # 65,536 buckets per class
DRAWS_PER_TASK = 100_000


def row_digest(key: Sequence[str], seed: int) -> Column:
    return keyed_md5(*[col(k) for k in key], str(seed))


def _bucketed(df: DataFrame, label: str, key: Sequence[str], seed: int, digits: int) -> DataFrame:
    return df.select(
        "*", row_digest(key, seed).alias("__digest")
    ).select("*", col(label).cast("string").alias("__label"), F.substring("__digest", 1, digits).alias("__bucket"))


def _bucket_starts(rows: DataFrame) -> DataFrame:
    """(__label, __bucket, size, start): how many rows of the class lie in earlier buckets.

    The window runs over one row per bucket, never over the rows themselves.
    """
    sizes = rows.groupBy("__label", "__bucket").agg(F.count(F.lit(1)).alias("size"))
    earlier = W.partitionBy("__label").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))


def lowest_by_hash(
    df: DataFrame, label: str, key: Sequence[str], quota: DataFrame, seed: int = SEED, digits: int = HEX_DIGITS
) -> DataFrame:
    """Exactly ``quota.target_n`` rows of each class, chosen by hash order.

    Bucket sizes tell in which bucket a class reaches its quota. Only that bucket is
    ordered, to find the digest of the last row to keep; the table itself is then
    just filtered against one threshold per class. Classes without a quota are kept.
    """
    rows = _bucketed(df, label, key, seed, digits)
    wanted = quota.select(F.col("label").alias("__label"), "target_n")
    starts = join_lookup(_bucket_starts(rows), wanted, ["__label"], "inner")
    edge = starts.where(
        (F.col("start") < F.col("target_n")) & (F.col("start") + F.col("size") >= F.col("target_n"))
    ).select("__label", "__bucket", (F.col("target_n") - F.col("start")).alias("room"))
    in_edge = join_lookup(rows.select("__label", "__bucket", "__digest"), edge, ["__label", "__bucket"], "inner")
    order = W.partitionBy("__label").orderBy("__digest")
    last = (
        in_edge.withColumn("place", F.row_number().over(order))
        .where(F.col("place") == F.col("room"))
        .select("__label", F.col("__digest").alias("__last"))
    )
    limits = wanted.join(last, "__label", "left").select(
        "__label",
        F.when(F.col("target_n") <= 0, "").otherwise(F.coalesce("__last", F.lit("g"))).alias("__last"),
    )
    kept = join_lookup(rows, limits, ["__label"], "left")
    return kept.where(F.col("__last").isNull() | (F.col("__digest") <= F.col("__last"))).select(
        *[col(c) for c in df.columns]
    )


def numbered_rows(
    df: DataFrame, label: str, key: Sequence[str], seed: int = SEED, digits: int = HEX_DIGITS
) -> DataFrame:
    """Adds ``__label`` and ``rn``: 0, 1, 2, ... inside each class, in hash order."""
    rows = _bucketed(df, label, key, seed, digits)
    local = F.row_number().over(W.partitionBy("__label", "__bucket").orderBy("__digest"))
    with_start = join_lookup(
        rows.withColumn("__local", local),
        _bucket_starts(rows).select("__label", "__bucket", "start"),
        ["__label", "__bucket"],
        "left",
        max_rows=1_000_000,
    )
    return with_start.withColumn("rn", F.col("start") + F.col("__local") - 1).drop(
        "__local", "__bucket", "__digest", "start"
    )


def draws(plan: DataFrame, per_task: int = DRAWS_PER_TASK) -> DataFrame:
    """(label, n, draw) with draw = 0 .. target_n - n - 1 for every class to be raised.

    Numbers are generated in blocks that are spread over the cluster first, so no
    task and no array holds a whole class.
    """
    need = F.col("target_n") - F.col("n")
    blocks = (
        plan.where(need > 0)
        .select("label", "n", need.alias("need"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("need") - 1) / per_task))).alias("block"))
        .repartition("label", "block")
    )
    first = F.col("block") * per_task
    return blocks.select(
        "label", "n",
        F.explode(F.sequence(first, F.least(first + per_task, F.col("need")) - 1)).alias("draw"),
    )


def drawn_index(label: Column, draw: Column, size: Column, seed: int, purpose: str = "row") -> Column:
    """A number below ``size`` that depends only on seed, class, draw and purpose."""
    digest = keyed_md5(str(seed), purpose, label, draw)
    return F.pmod(hash_int(digest, 1, 12), size)
