"""Lineage cut in the folder that all executors share, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import shared_folder


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, however far.

    ``edges`` has the columns ``a`` and ``b``; nodes that are their own component are left
    out. Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest neighbour, so chains halve; minima are combined before each shuffle, and no
    list of neighbours is built. Rounds end when nothing changes.
    """
    stars = settled(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(stars)
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.distinct()
        root = larger.groupBy("u").agg(F.min("v").alias("m"))
        rest = larger.join(root, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settled(root.select("u", F.col("m").alias("v")).unionAll(rest).distinct())
        now = _state(stars)
        if now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
