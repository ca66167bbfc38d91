"""Which columns count as numeric, categorical or temporal, and wide aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.numbers import clean_nan


def col(name: str) -> Column:
    """A column by its exact name, even if the name holds dots or dashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def columns_of_kind(df: DataFrame, *kinds: str, exclude: Iterable[str] = ()) -> list[str]:
    left_out = set(exclude)
    return [
        f.name for f in df.schema.fields if kind_of(f.dataType) in kinds and f.name not in left_out
    ]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of_kind(df, "numeric", exclude=exclude)


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of_kind(df, "categorical", exclude=exclude)


def flat_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Every column a profile covers; arrays, maps and structs stay out."""
    return columns_of_kind(df, "numeric", "categorical", "temporal", exclude=exclude)


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    return clean_nan(col(name), df.schema[name].dataType)


def number(df: DataFrame, name: str) -> Column:
    return value(df, name).cast("double")


def per_column(
    df: DataFrame, columns: list[str], shape: str, metrics: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """One wide aggregate over all columns, returned as one row per column.

    The table is scanned once and partial results are combined on the map side;
    only the single aggregate row is turned into long form. ``shape`` gives the types
    of the metrics, for the case that there is no column to look at.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, {shape}")
    rows = [
        F.struct(F.lit(c).alias("column"), *[m.alias(k) for k, m in metrics(c).items()])
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x): every number of every column, as doubles, nulls included.

    Grouping this by column keeps the generated code small however many columns and
    statistics there are; map-side combine leaves one row per task and column.
    """
    return long_values(df, columns, "x", "double", lambda c: number(df, c))


def long_values(
    df: DataFrame, columns: list[str], name: str, dtype: str, what: Callable[[str], Column]
) -> DataFrame:
    """(column, <name>): one expression per column, stacked below each other."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, {name} {dtype}")
    cells = [e for c in columns for e in (F.lit(c), what(c))]
    return df.select(F.stack(F.lit(len(columns)), *cells).alias("column", name))


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery, usable in any expression."""
    return df.select(F.count(F.lit(1)).alias("n")).scalar()
