"""Association of column pairs: Pearson, Spearman and Cramér's V."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import col, long_numbers, number, numeric_columns, value
from auditloom.functions.numbers import ratio
from auditloom.functions.ranges import dealt_values, range_counts, range_cuts, range_starts
from auditloom.functions.ranking import VALUES_PER_TASK
from auditloom.session import settled

# A correlation above this, in absolute value, is reported.
HIGH_CORRELATION = 0.8

ROUNDING = 1e-12
#: A value that more than a FREQUENT-th of the rows hold is likely in the sample by which ranges are cut.
FREQUENT = 10_000
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]

# The row reducer below travels with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def pair_moments(df: DataFrame, centres: dict[str, float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of column pairs over rows where both are known.

    ``df`` holds double columns only, in the order of ``centres``, whose values are
    taken off first so that no digits cancel. Each task reduces its rows to one small
    matrix per sum; Spark adds the matrices of all tasks. (One aggregate expression
    per pair would outgrow what the JVM compiles from about ten columns on.)
    """
    names = list(centres)
    shift = np.array([centres[c] for c in names])
    upper = np.triu_indices(len(names), 1)

    def reduce_rows(batches):
        total = None
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
            x = x - shift
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            known = known.astype(float)
            part = np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            sums = [pa.array(m[upper]) for m in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *sums],
                names=["i", "j", *SUMS],
            )

    shape = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    parts = df.select(*[col(c) for c in names]).mapInArrow(reduce_rows, shape)
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(df: DataFrame, centres: dict[str, float]) -> DataFrame:
    """(column_a, column_b, value): Pearson correlation of double columns; null without variation."""
    names = F.array(*[F.lit(c) for c in centres])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    var_x, var_y = F.col("sxx") - ratio(sx * sx, n), F.col("syy") - ratio(sy * sy, n)
    # what is left of a constant column is rounding
    flat = (var_x <= F.col("sxx") * ROUNDING) | (var_y <= F.col("syy") * ROUNDING)
    value = ratio(F.col("sxy") - ratio(sx * sy, n), F.sqrt(F.greatest(var_x * var_y, F.lit(0.0))))
    return pair_moments(df, centres).select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"),
        F.when(~flat, value).alias("value"),
    )


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are known."""
    names = numeric_columns(df) if columns is None else list(columns)
    means = {r["column"]: r["m"] for r in long_numbers(df, names).groupBy("column").agg(F.avg("x").alias("m")).collect()}
    centres = {c: means.get(c) or 0.0 for c in names}
    return correlations(df.select(*[number(df, c).alias(c) for c in names]), centres)


def high_correlations(df: DataFrame, threshold: float = HIGH_CORRELATION) -> DataFrame:
    return pearson(df).where(F.abs("value") > threshold)


PAIR = ["column_a", "column_b"]


def spearman(df: DataFrame, columns: Sequence[str] | None = None, parts: int | None = None) -> DataFrame:
    """Spearman correlation: Pearson correlation of average ranks, pairwise complete.

    One ranking serves all columns. Values are counted in blocks of rows and dealt by column and
    range, in all rows and in the rows that have each of the columns with nulls; ranks are running
    totals of the counts, one for all rows and one for each column with nulls. What travels is a
    row per block, column and range, not one per cell. Each block gets its ranks back, and a pair
    is correlated over the ranks among the rows that have both. The plan grows with the number of
    columns, not of pairs.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "column_a string, column_b string, value double")
    numbers = df.select(*[number(df, c).alias(c) for c in names])
    known = numbers.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"n_{k}") for k, c in enumerate(names)]).first()
    nullable = [c for k, c in enumerate(names) if known[f"n_{k}"] < known["n"]]
    n_kinds = len(nullable) + 1
    cuts = range_cuts(numbers, names, known["n"], parts or -(-known["n"] // VALUES_PER_TASK), 4 * FREQUENT)
    dealt = settled(dealt_values(numbers, names, cuts, nullable, places=True))
    starts, sizes = range_starts(dealt, n_kinds)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        _, counts, before, which = range_counts(pdf, n_kinds)
        ranks = (before + (counts + 1) / 2.0)[:, which]
        ends = np.cumsum([len(v) // 8 for v in pdf["x"]])[:-1]
        return pd.DataFrame({**{c: pdf[c] for c in ("block", "column", "range")}, "ranks": [part.tobytes() for part in np.split(ranks, ends, axis=1)]})

    ranged = dealt.select("block", "column", "range", "x", "n").join(starts, ["column", "range"])
    ranks = ranged.groupBy("column", "range").applyInPandas(rank, "block bigint, column int, range int, ranks binary")
    asked = dealt.select("block", "column", "range", F.lit(None).cast("binary").alias("ranks"), "n", "places")
    told = ranks.unionByName(asked, allowMissingColumns=True)
    products = _rank_products(names, nullable, {k: n for k, (n, _) in sizes.items()})
    sums = told.groupBy("block").applyInPandas(products, "i int, j int, sxx double, syy double, sxy double")
    # every pair is there, also where no row has both
    none = spark.createDataFrame([(i, j, 0.0, 0.0, 0.0) for i, j in combinations(range(len(names)), 2)], "i int, j int, sxx double, syy double, sxy double")
    sums = sums.unionAll(none).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in ("sxx", "syy", "sxy")])
    label = F.array(*[F.lit(c) for c in names])
    return sums.select(
        F.get(label, F.col("i")).alias("column_a"), F.get(label, F.col("j")).alias("column_b"),
        F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("value"),
    )


def _rank_products(names: list[str], nullable: list[str], sizes: dict):
    """Of a block the sums of squares and products of each pair's ranks about their mean."""
    which = [nullable.index(c) + 1 if c in nullable else 0 for c in names]
    n_ranks = len(nullable) + 1
    # the mean rank of column i among the rows that have column j
    means = [[(sizes[i][which[j]] + 1) / 2.0 if i in sizes else 0.0 for j in range(len(names))] for i in range(len(names))]
    pairs = list(combinations(range(len(names)), 2))
    whole = [i for i in range(len(names)) if not which[i]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        back = pdf["ranks"].notna()
        ranks = {(r.column, r.range): r.ranks for r in pdf[back].itertuples(index=False)}
        asked = [(r.column, ranks[r.column, r.range], r.n, np.frombuffer(r.places, np.int32)) for r in pdf[~back].itertuples(index=False)]
        table = np.full((n_ranks, len(names), max(places.max() for *_, places in asked) + 1), np.nan)
        for column, found, n, places in asked:
            n = np.frombuffer(n, np.int32).reshape(n_ranks, -1)[0]
            table[:, column, places] = np.repeat(np.frombuffer(found).reshape(n_ranks, -1), n, axis=1)
        # columns without nulls by one product, the others pair by pair
        full = table[0, whole] - np.array([means[i][i] for i in whole])[:, None]
        product = dict(zip(whole, full @ full.T, strict=True))
        at = {i: k for k, i in enumerate(whole)}
        total = np.zeros((len(pairs), 3))
        for k, (i, j) in enumerate(pairs):
            if i in at and j in at:
                total[k] = product[i][at[i]], product[j][at[j]], product[i][at[j]]
                continue
            x, y = table[which[j], i] - means[i][j], table[which[i], j] - means[j][i]
            both = ~(np.isnan(x) | np.isnan(y))
            x, y = x[both], y[both]
            total[k] = x @ x, y @ y, x @ y
        return pd.DataFrame({"i": [p[0] for p in pairs], "j": [p[1] for p in pairs], "sxx": total[:, 0], "syy": total[:, 1], "sxy": total[:, 2]})

    return run


def _pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(column_a, column_b, a, b, n): the contingency table of every pair, both sides known."""
    cells = [
        e for a, b in pairs
        for e in (F.lit(a), F.lit(b), value(df, a).cast("string"), value(df, b).cast("string"))
    ]
    return (
        df.select(F.stack(F.lit(len(pairs)), *cells).alias(*PAIR, "a", "b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy(*PAIR, "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cramér's V of every pair of categorical columns, without bias correction.

    chi² / n is the sum of n_ab² / (n_a n_b) over the cells that occur, minus one,
    so the empty cells of the contingency table are never built.
    """
    cells = _pair_cells(df, all_pairs(columns)).persist()
    by_a = cells.groupBy(*PAIR, "a").agg(F.sum("n").alias("n_a"))
    by_b = cells.groupBy(*PAIR, "b").agg(F.sum("n").alias("n_b"))
    levels = by_a.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("r")).join(
        by_b.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("c")), PAIR
    )
    share = F.col("n").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    phi2 = (
        cells.join(by_a, [*PAIR, "a"])
        .join(by_b, [*PAIR, "b"])
        .groupBy(*PAIR)
        .agg((F.sum(share) - 1.0).alias("phi2"))
    )
    return phi2.join(F.broadcast(levels), PAIR).select(
        *PAIR,
        F.sqrt(ratio(F.greatest("phi2", F.lit(0.0)), F.least("r", "c") - 1)).alias("value"),
    )
