"""Exact linear quantiles that never hold a whole column in one task.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation
buffer. That is fine up to ``DIRECT_ROWS`` rows. For larger tables the wanted order
statistics are found by narrowing: doubles in order are whole numbers in order once their
bits are read as such, so a pass counts the rows of each range of leading bits, and the range
that a wanted rank falls into is cut by the next bits in the next pass. A range of few rows is
counted by single values, and one of a single value is done. Whatever the values are, six
passes are the most, and mostly three do. Each task reduces its rows to its counts; what comes
back is bounded by the number of ranges, not of rows.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import long_numbers, number

DIRECT_ROWS = 100_000
INTERVAL_ROWS = 20_000
#: Into how many ranges a pass cuts each open one; a power of two.
ACCURACY = 16_384
BITS = 64

# The row reducer below travels with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Quantiles = dict[str, list[float] | None]


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    n_rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
    interval_rows: int = INTERVAL_ROWS,
) -> Quantiles:
    """Per column the list of its quantiles, or None if it holds no value."""
    if not columns:
        return {}
    if n_rows is None:
        n_rows = df.count()
    if n_rows > direct_rows:
        return narrowed_quantiles(df, columns, probs, interval_rows)
    wanted = F.percentile("x", F.array(*[F.lit(float(p)) for p in probs]))
    rows = long_numbers(df, columns).groupBy("column").agg(wanted.alias("q")).collect()
    found = {r["column"]: r["q"] for r in rows}
    return {c: found.get(c) for c in columns}


def quantile_frame(df: DataFrame, found: Quantiles, names: list[str]) -> DataFrame:
    """(column, *names): one row per column that holds a value."""
    rows = [(c, *q) for c, q in found.items() if q is not None]
    schema = ", ".join(["column string", *[f"{n} double" for n in names]])
    return df.sparkSession.createDataFrame(rows, schema)


def narrowed_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    interval_rows: int = INTERVAL_ROWS,
    accuracy: int = ACCURACY,
) -> Quantiles:
    step = max(1, accuracy.bit_length() - 1)
    n: dict[str, int] = dict.fromkeys(columns, 0)
    answers: dict[tuple[str, int], float] = {}
    # (column, bits left, leading bits) of each open range, the bits left after the pass, and the ranks in it
    open_ranges = {(c, BITS, 0): (BITS - step, None) for c in columns}
    while open_ranges:
        cells = _count_cells(df, columns, {at: left for at, (left, _) in open_ranges.items()})
        following: dict[tuple[str, int, int], tuple[int, list[tuple[int, int]]]] = {}
        for at, (left, ranks) in open_ranges.items():
            c, found = at[0], cells.get(at, [])
            if ranks is None:  # the first pass tells how many values there are
                n[c] = sum(size for _, size, _, _ in found)
                ranks = [(r, r) for r in sorted({r for p in probs for r in _ranks(p, n[c])})] if n[c] else []
            for rank, place in ranks:
                cell, before, size, low, high = _locate(found, place)
                if low == high:
                    answers[c, rank] = _value(low)
                else:
                    rest = 0 if size <= interval_rows else max(0, left - step)
                    following.setdefault((c, left, cell), (rest, []))[1].append((rank, place - before))
        open_ranges = following
    return {
        c: [_interpolate(p, n[c], c, answers) for p in probs] if n[c] else None for c in columns
    }


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(p: float, n: int, c: str, answers: dict) -> float:
    low, high = _ranks(p, n)
    share = p * (n - 1) - low
    return answers[c, low] + (answers[c, high] - answers[c, low]) * share


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _value(key: int) -> float:
    bits = np.array([key], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (range, cell, n, low, high), one for each range and cell."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    new = np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
    first = np.flatnonzero(new)
    reduced = [f.reduceat(rows[k], first) for k, f in ((2, np.add), (3, np.minimum), (4, np.maximum))]
    return np.stack([rows[0, first], rows[1, first], *reduced])


def _count_cells(df: DataFrame, columns: list[str], ranges: dict[tuple[str, int, int], int]) -> dict[tuple[str, int, int], list]:
    """(cell, n, smallest, largest) of each open range in ascending order; a cell is the bits that are left out."""
    wanted = list(ranges.items())
    places = [(k, columns.index(c), left, prefix, rest) for k, ((c, left, prefix), rest) in enumerate(wanted)]
    used = sorted({p[1] for p in places})

    def reduce_rows(batches):
        parts, held = [], 0
        for batch in batches:
            for at, column in enumerate(used):
                x = batch.column(at).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                keys = np.sort(_ordered(x[~np.isnan(x)]))
                for k, of, left, prefix, rest in places:
                    if of != column:
                        continue
                    some = keys
                    if left < BITS:
                        some = keys[np.searchsorted(keys, prefix << left) : np.searchsorted(keys, (prefix << left) + ((1 << left) - 1), "right")]
                    if not len(some):
                        continue
                    cells = some >> rest
                    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                    last = np.append(first[1:], len(cells))
                    parts.append(np.stack([np.full(len(first), k), cells[first], last - first, some[first], some[last - 1]]))
                    held += len(first)
            if held > 1_000_000:
                parts = [_summed(parts)]
                held = 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(row) for row in _summed(parts)], ["range", "cell", "n", "low", "high"])

    numbers = df.select(*[number(df, columns[at]).alias(f"c{at}") for at in used])
    counted = numbers.mapInArrow(reduce_rows, "range bigint, cell bigint, n bigint, low bigint, high bigint")
    summed = counted.groupBy("range", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[tuple[str, int, int], list] = {}
    for r in sorted(summed.collect()):
        out.setdefault(wanted[r["range"]][0], []).append((r["cell"], r["n"], r["low"], r["high"]))
    return out


def _locate(cells: list[tuple[int, int, int, int]], rank: int) -> tuple[int, int, int, int, int]:
    before = 0
    for cell, size, low, high in cells:
        if rank < before + size:
            return cell, before, size, low, high
        before += size
    raise AssertionError("a rank lies beyond the counted rows")
