"""Numeric expressions: guarded ratios, sample-size corrected moments, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def zero_if_undefined(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where the denominator is zero (the usual zero_division=0)."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def sample_skewness(population_skew: Column, n: Column) -> Column:
    """Bias-corrected G1 from Spark's population g1; null below three values."""
    n = n.cast("double")
    return F.when(n >= 3, population_skew * F.sqrt(n * (n - 1)) / F.try_subtract(n, F.lit(2.0)))


def sample_kurtosis(population_kurt: Column, n: Column) -> Column:
    """Bias-corrected excess G2 from Spark's population g2; null below four values."""
    n = n.cast("double")
    return F.when(
        n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * population_kurt + 6)
    )


def clean_nan(c: Column, dtype: T.DataType) -> Column:
    """NaN counts as missing everywhere, so floats lose it before any statistic."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that summation order cannot show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL = 0.02425
# Abramowitz and Stegun's approximation of the normal tail (error 7.5e-8).
TAIL_STEP = 0.2316419
TAIL_SERIES = [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0]


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal variable falls with probability ``p`` in (0, 1)."""
    q = p - 0.5
    centre = q * _polynomial(CENTRE_TOP, q * q) / _polynomial(CENTRE_BOTTOM, q * q)
    far = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _polynomial(TAIL_TOP, far) / _polynomial(TAIL_BOTTOM, far)
    return F.when(p < TAIL, tail).when(p > 1.0 - TAIL, -tail).otherwise(centre)


def normal_upper_tail(z: Column) -> Column:
    """The probability that a standard normal variable exceeds ``z``."""
    far = F.abs(z)
    tail = F.exp(-far * far / 2.0) / (2.0 * math.pi) ** 0.5 * _polynomial(TAIL_SERIES, 1.0 / (1.0 + TAIL_STEP * far))
    return F.when(z >= 0, tail).otherwise(1.0 - tail)
