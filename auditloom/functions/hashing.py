"""Deterministic pseudo-random numbers from md5: equal under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_md5(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by dashes, for example (id, seed). A null part counts as such."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]))


def hash_int(digest: Column, start: int = 1, digits: int = 8) -> Column:
    """A slice of the digest as an unsigned integer."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def unit_interval(digest: Column) -> Column:
    """A number in [0, 1) with 32 random bits."""
    return hash_int(digest).cast("double") / F.lit(float(2**32))
