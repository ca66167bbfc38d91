"""Joining a small derived table to a large one, with the size checked first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def join_lookup(
    big: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    null_safe: bool = False,
    max_rows: int = BROADCAST_ROWS,
    n_rows: int | None = None,
) -> DataFrame:
    """Add the columns of ``lookup`` (one row per key) to ``big``.

    The lookup is counted once, unless ``n_rows`` is known. Up to ``max_rows`` it is
    broadcast, so the big side never moves; beyond that both sides are shuffled on
    the key and AQE may split skewed keys.
    """
    if n_rows is None:
        lookup = lookup.persist()
        n_rows = lookup.count()
    fits = n_rows <= max_rows
    renamed = lookup.select(
        *[F.col(f"`{k}`").alias(f"__k_{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in lookup.columns if c not in keys],
    )
    if fits:
        renamed = F.broadcast(renamed)
    tests: list[Column] = []
    for i, k in enumerate(keys):
        right = F.col(f"__k_{i}")
        left = F.col(f"`{k}`")
        tests.append(left.eqNullSafe(right) if null_safe else left == right)
    joined = big.join(renamed, reduce(lambda a, b: a & b, tests), how)
    return joined.drop(*[f"__k_{i}" for i in range(len(keys))])
