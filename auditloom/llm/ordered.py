"""Rows dealt into consecutive ranges of a key, however long a run of equal keys is."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def firsts(rows: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """The smallest key of each of about ``parts`` ranges that hold about as many rows each.

    Only keys are read, and one key a range reaches the driver.
    """
    ranged = rows.select(*keys).repartitionByRange(parts, *keys)
    found = ranged.groupBy(F.spark_partition_id().alias("__range")).agg(F.min(F.struct(*keys)).alias("first")).collect()
    return sorted((tuple(r["first"]) for r in found), key=_ordered)


def _ordered(key: tuple) -> tuple:
    """Spark's ascending order: null first."""
    return tuple((k is not None, k) for k in key)


def in_ranges(rows: DataFrame, keys: list[str], parts: int, closed: bool = False) -> tuple[DataFrame, int]:
    """The rows with ``__part``, the number of their range, and how many ranges there are.

    Rows of equal keys are in one range. ``closed`` adds to each range copies of the rows
    of the next range's first key (to the last range those of the first), marked in
    ``__next``, so that every row finds the one after it in its own range.
    """
    starts = [_ordered(k) for k in firsts(rows, keys, parts)]

    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            given = [_ordered(k) for k in zip(*columns, strict=True)]
            part = np.fromiter((bisect_right(starts, k) - 1 for k in given), np.int64, len(given))
            yield _with(batch, part, False)
            if closed:
                at = np.array([i for i, (k, p) in enumerate(zip(given, part, strict=True)) if starts[p] == k], np.int64)
                if len(at):
                    yield _with(batch.take(pa.array(at)), (part[at] - 1) % len(starts), True)

    def _with(batch, part, mark):
        extra = [pa.array(part), *([pa.array(np.full(len(part), mark))] if closed else [])]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names)

    names = [*rows.columns, "__part", *(["__next"] if closed else [])]
    extra = [T.StructField("__part", T.LongType()), *([T.StructField("__next", T.BooleanType())] if closed else [])]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *extra])), max(1, len(starts))
