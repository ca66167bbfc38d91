"""Rows and their values dealt by ranges, so that ranks need no row per cell.

Tasks cut their rows into blocks. Of each column of a block, equal values are counted, and those
of one range make one row: a range gets all its values in few rows, a value held by many rows once
for each block, and what it finds goes back to the blocks in as few. Ranges are cut at values of a
sample, which decides how large they are and nothing else.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.columns import col

SEED = 42
#: Cells that a task holds as one block, and rows of a block.
BLOCK_CELLS, BLOCK_ROWS = 1 << 22, 1 << 18
SHAPE = "block bigint, column int, range int, x binary, n binary, places binary, rows array<bigint>, total double"

# The small functions below travel with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def range_cuts(numbers: DataFrame, names: Sequence[str], n_rows: int, parts: int, sample_rows: int) -> list[np.ndarray]:
    """For each column the ascending values at which its ranges begin, but for the first; about ``parts`` ranges."""
    if parts <= 1 or not n_rows:
        return [np.empty(0) for _ in names]
    sample_rows = max(sample_rows, 64 * parts)
    sample = numbers.select(*[col(c).alias(f"c{k}") for k, c in enumerate(names)])
    if sample_rows < n_rows:
        sample = sample.sample(False, sample_rows / n_rows, SEED)
    cuts = []
    for x in sample.toPandas().to_numpy(dtype=float, na_value=np.nan).T:
        x = np.sort(x[~np.isnan(x)]) + 0.0
        cuts.append(np.unique(x[np.arange(1, parts) * len(x) // parts]) if len(x) else x)
    return cuts


def dealt_values(numbers: DataFrame, names: Sequence[str], cuts: list[np.ndarray], nullable: Sequence[str] = (), places: bool = False) -> DataFrame:
    """A row for each block, column and range: its values ``x`` in order, and ``n``, how many rows of
    the block hold each, of all rows and of those that have each of ``nullable``; ``rows`` and
    ``total`` sum these counts and the values. ``places``: which rows of the block, in that order.
    ``numbers`` holds doubles without NaN.
    """
    known_of = [list(names).index(c) for c in nullable]
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // (len(names) * (1 + len(nullable)))))

    def deal(batches, block):
        out = []
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False).astype(float) for b in batches]) for i in range(len(names))]
        known = [~np.isnan(columns[i]) for i in known_of]
        for i, x in enumerate(columns):
            at = np.flatnonzero(~np.isnan(x))
            if not len(at):
                continue
            x = x[at] + 0.0  # both zeros are one
            if places or known:
                order = np.argsort(x)
                at, x = at[order], x[order]
            else:
                x.sort()
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            ends = np.append(first, len(x))
            n = np.stack([np.diff(ends), *[np.add.reduceat(k[at].astype(np.int64), first) for k in known]])
            values = x[first]
            of = np.searchsorted(cuts[i], values, side="right")
            edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            for s, e in zip(edges, edges[1:]):
                cells = slice(ends[s], ends[e])
                which = at[cells].astype(np.int32).tobytes() if places else b""
                out.append((block, i, int(of[s]), values[s:e].tobytes(), n[:, s:e].astype(np.int32).tobytes(), which, n[:, s:e].sum(1).tolist(), float(x[cells].sum())))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
        fields = [f.split(" ")[0] for f in SHAPE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], fields)

    def run(batches):
        held, n_held, block = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                n_held += held[-1].num_rows
                if n_held >= block_rows:
                    yield deal(held, block)
                    held, n_held, block = [], 0, block + 1
        if n_held:
            yield deal(held, block)

    return numbers.select(*[col(c) for c in names]).mapInArrow(run, SHAPE)


def range_starts(dealt: DataFrame, n_kinds: int = 1) -> tuple[DataFrame, dict[int, tuple[list[int], float]]]:
    """(column, range, start): how many rows lie in the ranges before, by kind of count; and the
    counts and the sum of each column that has values."""
    counts = [f"n_{k}" for k in range(n_kinds)]
    totals = dealt.groupBy("column", "range").agg(*[F.sum(F.col("rows")[k]).alias(c) for k, c in enumerate(counts)], F.sum("total").alias("total"))
    before = W.partitionBy("column").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = totals.select("column", "range", F.array(*[F.coalesce(F.sum(c).over(before), F.lit(0)) for c in counts]).alias("start"))
    sizes = totals.groupBy("column").agg(*[F.sum(c).alias(c) for c in counts], F.sum("total").alias("total")).collect()
    return starts, {r["column"]: ([r[c] for c in counts], r["total"]) for r in sizes}


def range_counts(pdf, n_kinds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows of one range: its values, how many rows hold each and how many lie before, by kind
    of count; and which of the values those of the rows are, one after the other."""
    x = np.concatenate([np.frombuffer(v) for v in pdf["x"]])
    n = np.concatenate([np.frombuffer(v, np.int32).reshape(n_kinds, -1) for v in pdf["n"]], axis=1)
    values, which = np.unique(x, return_inverse=True)
    counts = np.stack([np.bincount(which, row, len(values)) for row in n]).astype(np.int64)
    before = np.asarray(pdf["start"].iloc[0], np.int64)[:, None] + np.cumsum(counts, axis=1) - counts
    return values, counts, before, which
