"""Value counts: the building block under profiles, balance and fairness."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import col, flat_columns, per_column, value
from auditloom.functions.joins import join_lookup
from auditloom.functions.numbers import pct
from auditloom.session import settled

# Texts of more bytes are told apart by their digests where only their number counts.
LONG_TEXT = 48
PREFIX = 16
KINDS = ["whole", "real", "text"]
KEY = ["column", "whole", "real", "text", "digest"]


def typed_counts(df: DataFrame, columns: list[str], digests: bool = False) -> DataFrame:
    """(column, whole, real, text, n): rows per value, in the column's own kind of type.

    Numbers are shuffled and compared as numbers; they only become text afterwards,
    once per distinct value. A row with all three null counts the column's nulls. With
    ``digests`` long texts are replaced by their digests, so none is shuffled.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, whole bigint, real double, text string, n bigint")

    def parts(c: str) -> list[Column]:
        whole, real, text = _parts(df, c)
        if digests:
            text = F.when(F.octet_length(text) > LONG_TEXT, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)
        return [whole, real, text]

    cells = [e for c in columns for e in (F.lit(c), *parts(c))]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "whole", "real", "text"))
    return long.groupBy("column", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))


def keyed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, whole, real, text, digest, n): :func:`typed_counts` that shuffle no long text.

    Of a text of more than ``LONG_TEXT`` bytes only its first characters stand in ``text``,
    and ``digest`` tells it apart. Everything a report says of single columns follows from
    these counts, so that it needs one scan and one shuffle, combined in each task first.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, whole bigint, real double, text string, digest string, n bigint")
    # keys are as narrow as the columns allow: a number for the column, and only the kinds that occur
    kinds = [kind for kind in KINDS if any(_kind(df, c) == kind for c in columns)]
    cells = [e for i, c in enumerate(columns) for e in (F.lit(i), *[_parts(df, c)[KINDS.index(kind)] for kind in kinds])]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("place", *kinds))
    if "text" in kinds:
        is_long = F.octet_length("text") > LONG_TEXT
        long = long.withColumn("digest", F.when(is_long, F.md5("text")))
        long = long.withColumn("text", F.when(is_long, F.substring("text", 1, PREFIX)).otherwise(F.col("text")))
        kinds = [*kinds, "digest"]
    counts = long.groupBy("place", *kinds).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    empty = {"whole": "bigint", "real": "double", "text": "string", "digest": "string"}
    return counts.select(
        F.get(names, F.col("place")).alias("column"),
        *[F.col(k) if k in kinds else F.lit(None).cast(t).alias(k) for k, t in empty.items()], "n",
    )


def _kind(df: DataFrame, c: str) -> str:
    dtype = df.schema[c].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    return "real" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "text"


def _parts(df: DataFrame, c: str) -> list[Column]:
    """The column as whole number, as real number, as text: one of them."""
    kind, x = _kind(df, c), value(df, c)
    return [
        (x if kind == "whole" else F.lit(None)).cast("bigint"),
        (x if kind == "real" else F.lit(None)).cast("double"),
        (x.cast("string") if kind == "text" else F.lit(None).cast("string")),
    ]


def column_facts(df: DataFrame, columns: list[str], counts: DataFrame | None = None, moments: bool = False) -> DataFrame:
    """(column, n_rows, n_null, n_unique, n_single, mean, min, max, n_zeros, and on demand std, g1, g2).

    All from the value counts; ``n_single`` values occur once, and moments are about the
    mean, which is known by then. Numbers are null for columns of other kinds.
    """
    counts = keyed_counts(df, columns) if counts is None else counts
    decimals = [c for c in columns if isinstance(df.schema[c].dataType, T.DecimalType)]
    known = F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull()
    x = F.coalesce(F.col("whole").cast("double"), "real", F.when(F.col("column").isin(decimals), F.expr("try_cast(text as double)")))
    n = F.when(x.isNotNull(), F.col("n"))
    facts = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count_if(known).alias("n_unique"), F.count_if(known & (F.col("n") == 1)).alias("n_single"),
        F.try_divide(F.sum(x * n), F.sum(n).cast("double")).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.when(F.sum(n) > 0, F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0))).alias("n_zeros"),
    )
    if not moments:
        return facts
    centred = counts.join(F.broadcast(facts.select("column", "mean")), "column").withColumn("d", x - F.col("mean"))
    weighted = [F.sum(F.when(F.col("d").isNotNull(), F.col("n")) * F.pow("d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)]
    sums = centred.groupBy("column").agg(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))).cast("double").alias("k"), *weighted)
    k, m2 = F.col("k"), F.col("m2")
    spread = sums.select(
        "column", F.when(k > 1, F.sqrt(F.try_divide(m2, k - 1))).alias("std"),
        F.when(m2 > 0, F.sqrt(k) * F.col("m3") / F.pow(m2, F.lit(1.5))).alias("g1"),
        F.when(m2 > 0, k * F.col("m4") / (m2 * m2) - 3.0).alias("g2"),
    )
    return facts.join(F.broadcast(spread), "column", "left")


def leading_values(
    df: DataFrame, columns: list[str], k: int, smallest: bool = False, facts: bool = False, moments: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """(column, rank, value, n, pct): the k most frequent values of each column, or the k smallest.

    Ties go by value. The counts decide with the first characters of long texts; only what
    can still be among the first k, ties included, is looked up in the table by its digest.
    With ``facts`` the second result is :func:`column_facts`, from the same scan.
    """
    counts = keyed_counts(df, columns)
    shown = F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string"))
    by = ["whole", "real", "text"] if smallest else [F.col("n").desc(), shown]
    known = counts.where(shown.isNotNull())
    # k keys a column and task meet in one task, which says where the first k end; ties with the last are taken in by a filter
    first = known.withColumn("place", F.row_number().over(W.partitionBy("column").orderBy(*by))).where(F.col("place") <= k)
    ends = first.withColumn("shown", shown).groupBy("column").agg(F.max_by(F.struct("whole", "real", "text", "n", "shown"), "place").alias("end"))
    end = lambda c: F.col("end")[c]
    up_to = (F.col("n") > end("n")) | ((F.col("n") == end("n")) & (shown <= end("shown")))
    if smallest:
        up_to = F.coalesce(*[F.col(c) <= end(c) for c in KINDS])
    found = known.join(F.broadcast(ends), "column").where(up_to)
    kept = found.select(*KEY, "n", F.lit(None).cast("bigint").alias("n_rows"))
    told = column_facts(df, columns, counts, moments)
    kept = settled(kept.unionByName(told if facts else told.select("column", "n_rows"), allowMissingColumns=True))
    near, told = kept.where("n_rows is null"), kept.where("n_rows is not null")
    totals = told.select("column", F.col("n_rows").alias("of"))
    near = near.select(*KEY, "n").join(F.broadcast(totals), "column").withColumn("value", shown)
    long = near.where("digest is not null").select("column", "digest", "n", "of")
    n_long = long.count()
    if n_long:
        names = [c for c in columns if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
        cells = [e for c in names for e in (F.lit(c), _parts(df, c)[2])]
        texts = df.select(F.stack(F.lit(len(names)), *cells).alias("column", "value")).where(F.octet_length("value") > LONG_TEXT)
        texts = join_lookup(texts.withColumn("digest", F.md5("value")), long, ["column", "digest"], "inner", n_rows=n_long)
        whole = texts.groupBy("column", "digest", "n", "of").agg(F.any_value("value").alias("value"))
        near = near.where("digest is null").unionByName(whole, allowMissingColumns=True)
    order = ["whole", "real", "value"] if smallest else [F.col("n").desc(), F.col("value")]
    top = near.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(*order))).where(F.col("rank") <= k)
    top = top.select("column", "rank", "value", "n", pct(F.col("n"), F.col("of")).alias("pct"))
    return top, told.drop("whole", "real", "text", "digest", "n") if facts else None


def _all_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) with a row for nulls too."""
    as_text = F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string"))
    return typed_counts(df, columns).select("column", as_text.alias("value"), "n")


def value_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, value, n, pct): nulls are not listed but count in the denominator.

    The row total per column comes from the same counts (the shuffle is reused),
    so the table is read once; the totals have one row per column.
    """
    counts = _all_counts(df, flat_columns(df) if columns is None else list(columns))
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_rows"))
    return (
        counts.where(F.col("value").isNotNull())
        .join(F.broadcast(totals), "column")
        .select("column", "value", "n", pct(F.col("n"), F.col("n_rows")).alias("pct"))
    )


def top_values(counts: DataFrame, k: int, by: Sequence[str] = ("column",)) -> DataFrame:
    """The k most frequent values per column with their rank; ties go by value.

    Spark limits each map task to k rows per column before the shuffle.
    """
    order = W.partitionBy(*by).orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, n_unique), nulls excluded, exact; columns without a value give 0."""
    counts = typed_counts(df, flat_columns(df) if columns is None else list(columns), digests=True)
    known = F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull()
    return counts.groupBy("column").agg(F.count_if(known).alias("n_unique"))


def approx_distinct_counts(df: DataFrame, columns: Iterable[str] | None = None, rsd: float = 0.05) -> DataFrame:
    """Opt-in estimate of :func:`distinct_counts` that shuffles only sketches."""
    names = flat_columns(df) if columns is None else list(columns)
    return per_column(
        df, names, "n_unique bigint", lambda c: {"n_unique": F.approx_count_distinct(value(df, c), rsd)}
    )


def joint_counts(df: DataFrame, columns: Sequence[str], n: str = "n") -> DataFrame:
    """Rows per combination of the columns: the only shuffle group statistics need.

    Everything about groups, pairs of groups and labels is derived from this one
    result, whose size is the number of combinations and not the number of rows.
    """
    names = list(dict.fromkeys(columns))
    return (
        df.select(*[value(df, c).alias(c) for c in names])
        .groupBy(*[col(c) for c in names])
        .agg(F.count(F.lit(1)).alias(n))
    )


def cell_rows(df: DataFrame, columns: Sequence[str], n: str = "n") -> DataFrame:
    """The columns row by row, each counting once: what :func:`joint_counts` sums up.

    For statistics of single columns and pairs, which are then grouped by those alone;
    the joint combinations of many columns would be nearly as many as the rows.
    """
    names = list(dict.fromkeys(columns))
    return df.select(*[value(df, c).alias(c) for c in names], F.lit(1).cast("bigint").alias(n))


def group_key(names: Sequence[str], null_label: str | None) -> Column:
    """The group's values as an array of texts: pairs stay pairs, never glued together."""
    parts = [col(c).cast("string") for c in names]
    if null_label is not None:
        parts = [F.coalesce(p, F.lit(null_label)) for p in parts]
    return F.array(*parts)


def group_label(key: Column) -> Column:
    return F.array_join(key, "_")


def long_groups(
    cells: DataFrame,
    groupings: Sequence[Sequence[str]],
    keep: Sequence[str],
    null_label: str | None = None,
) -> DataFrame:
    """One row per cell and grouping: (attr, key, *keep).

    A grouping is one column, or several for an intersectional group. Without a
    ``null_label`` cells whose group is null are left out of that grouping.
    """
    options = F.array(
        *[
            F.struct(F.lit("_".join(g)).alias("attr"), group_key(g, null_label).alias("key"))
            for g in groupings
        ]
    )
    out = cells.select(F.inline(options), *[col(c) for c in keep])
    if null_label is None:
        out = out.where(~F.exists("key", lambda k: k.isNull()))
    return out
