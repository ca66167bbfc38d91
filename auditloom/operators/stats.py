"""Statistical screens: normality by moments and by order statistics, and unstable variation."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import long_numbers, number, numeric_columns
from auditloom.functions.numbers import CENTRE_BOTTOM, CENTRE_TOP, TAIL, TAIL_BOTTOM, TAIL_TOP, normal_upper_tail
from auditloom.functions.ranges import dealt_values, range_counts, range_cuts, range_starts
from auditloom.functions.ranking import VALUES_PER_TASK
from auditloom.session import settled

# Significance level, variation limit.
ALPHA = 0.05
VARIATION_LIMIT = 2.0
NO_TEMPORAL = "No temporal columns detected - cannot assess temporal drift risk"
DRIFT_OK = "Implement monitoring for data drift in production"
DRIFT_RISK = "Address identified risks before deployment"

# The small functions below travel with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normality_screen(df: DataFrame) -> DataFrame:
    """Jarque-Bera test of all numeric columns over all their rows.

    Its statistic needs only population moments, so one grouped aggregate serves
    every column, and its tail probability has the closed form exp(-JB / 2). Columns with
    three values or fewer, or without variation, are not judged.
    """
    names = numeric_columns(df)
    moments = long_numbers(df, names).groupBy("column").agg(
        F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")
    )
    jb = F.col("n") / 6.0 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4.0)
    return (
        moments.where((F.col("n") > 3) & F.col("g1").isNotNull() & ~F.isnan("g1"))
        .select("column", "n", jb.alias("jb"))
        .withColumn("p_value", F.exp(-F.col("jb") / 2.0))
        .withColumn("is_normal", F.col("p_value") > ALPHA)
    )


#: Ranks that are scored together; longer runs of ties are cut. And how many of these a task scores.
RUN, RUNS_A_TASK = 1 << 18, 32
SAMPLE_ROWS = 40_000


def shapiro_francia(df: DataFrame, values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Shapiro-Francia test of all numeric columns over all their rows.

    ``w`` is the squared correlation of the ordered values with the normal scores of their
    ranks (Blom's positions). Values are counted in blocks and dealt by ranges of about
    ``values_per_task`` rows, so that ranks are running totals of counts; a run of equal values
    is cut into pieces, which are dealt anew, and only then scored, rank by rank. ``p_value``
    follows Royston's normal approximation of ln(1 - w), fitted for 5 to 5,000 rows and
    extrapolated beyond. Columns with fewer than five values, without variation, or with an
    infinite value are not judged.
    """
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n bigint, w double, p_value double, is_normal boolean")
    numbers = df.select(*[number(df, c).alias(c) for c in names])
    n_rows = numbers.count()
    cuts = range_cuts(numbers, names, n_rows, -(-n_rows // values_per_task), SAMPLE_ROWS)
    dealt = settled(dealt_values(numbers, names, cuts).drop("places"))
    starts, sizes = range_starts(dealt)
    facts = {k: (n, total / n) for k, ((n,), total) in sizes.items()}

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, before, _ = range_counts(pdf)
        n, before = n[0], before[0]
        cut = -(-n // RUN)
        nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        x, first = np.repeat(x, cut), np.repeat(before, cut) + nth * RUN
        n = np.minimum(RUN, np.repeat(n, cut) - nth * RUN)
        together = (np.cumsum(n) - 1) // RUN
        edges = np.append(np.flatnonzero(np.append(True, together[1:] != together[:-1])), len(n))
        parts = [slice(s, e) for s, e in zip(edges, edges[1:])]
        return pd.DataFrame({"column": pdf["column"].iloc[0], **{c: [v[at].tobytes() for at in parts] for c, v in (("x", x), ("first", first), ("n", n))}})

    def score(batches):  # in Arrow, as pandas would make NaN null
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n_all, mean = facts[row["column"]]
                x, first, n = (np.frombuffer(row[c], t) for c, t in (("x", float), ("first", np.int64), ("n", np.int64)))
                ends = np.cumsum(n)
                ranks = np.repeat(first - (ends - n), n) + np.arange(1, ends[-1] + 1)
                m = _normal_quantiles((ranks - 0.375) / (n_all + 0.25))
                with np.errstate(invalid="ignore", over="ignore"):
                    d = x - mean
                    out.append((row["column"], int(ends[-1]), d @ np.add.reduceat(m, ends - n), (d * d) @ n, m @ m))
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["column", "n", "dm", "dd", "mm"])

    ranged = dealt.select("column", "range", "x", "n").join(starts, ["column", "range"])
    runs = ranged.groupBy("column", "range").applyInPandas(pieces, "column int, x binary, first binary, n binary")
    tasks = max(1, -(-sum(n for n, _ in facts.values()) // (RUN * RUNS_A_TASK)))
    scored = runs.repartition(tasks).mapInArrow(score, "column int, n bigint, dm double, dd double, mm double")
    label = F.array(*[F.lit(c) for c in names])
    sums = scored.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("n", "dm", "dd", "mm")])
    w = F.col("dm") * F.col("dm") / (F.col("dd") * F.col("mm"))
    judged = sums.where((F.col("n") >= 5) & (F.col("dd") > 0) & ~F.isnan("dd")).select(F.get(label, F.col("column")).alias("column"), "n", w.alias("w"))
    p = normal_upper_tail(_royston(F.col("w"), F.col("n")))
    return judged.withColumn("p_value", p).withColumn("is_normal", F.col("p_value") > ALPHA)


def _normal_quantiles(p: np.ndarray) -> np.ndarray:
    """``normal_quantile`` of an array."""
    q = p - 0.5
    out = q * np.polyval(CENTRE_TOP, q * q) / np.polyval(CENTRE_BOTTOM, q * q)
    for far, sign in ((p < TAIL, 1.0), (p > 1.0 - TAIL, -1.0)):
        if far.any():
            t = np.sqrt(-2.0 * np.log(np.minimum(p[far], 1.0 - p[far])))
            out[far] = sign * np.polyval(TAIL_TOP, t) / np.polyval(TAIL_BOTTOM, t)
    return out


def _royston(w: Column, n: Column) -> Column:
    # Royston's approximation of mean and deviation of ln(1 - w).
    log_n = F.log(n.cast("double"))
    mean = -1.2725 + 1.0521 * (F.log(log_n) - log_n)
    deviation = 1.0308 - 0.26758 * (F.log(log_n) + 2.0 / log_n)
    return (F.log(F.greatest(1.0 - w, F.lit(1e-300))) - mean) / deviation


def variation_risk(df: DataFrame) -> DataFrame:
    """Coefficient of variation of all numeric columns; a negative mean never triggers."""
    names = numeric_columns(df)
    out = long_numbers(df, names).groupBy("column").agg(
        F.try_divide(F.stddev_samp("x"), F.avg("x") + F.lit(1e-10)).alias("cv")
    )
    return out.select("column", "cv", F.coalesce(F.col("cv") > VARIATION_LIMIT, F.lit(False)).alias("risky"))


def drift_recommendation(df: DataFrame) -> DataFrame:
    """One row: the number of risks (no date column counts as one) and what to do."""
    temporal = any(w in c.lower() for c in df.columns for w in ("date", "time", "year"))
    risks = F.count_if("risky") + F.lit(0 if temporal else 1)
    return variation_risk(df).agg(
        risks.alias("n_risks"),
        F.when(risks > 0, DRIFT_RISK).otherwise(DRIFT_OK).alias("recommendation"),
        F.lit(None if temporal else NO_TEMPORAL).cast("string").alias("notice"),
    )
