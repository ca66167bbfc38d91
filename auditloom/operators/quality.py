"""Data quality: missing values, mixed types, duplicates, outliers, overall score."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import (
    col,
    flat_columns,
    long_numbers,
    long_values,
    number,
    numeric_columns,
    per_column,
    row_count,
    string_columns,
    value,
)
from auditloom.functions.numbers import pct
from auditloom.functions.quantiles import exact_quantiles, quantile_frame
from auditloom.operators.counts import approx_distinct_counts, distinct_counts
from auditloom.operators.profile import sample_values
from auditloom.sources.nulls import BLANK, blank_to_null, infer_types, null_tokens, tokens

# Numbers that often stand for "unknown", and score limits.
SENTINELS = [-999, -99, -9, 999, 9999, 99999, -1]
GRADES = [
    (90, "A - EXCELLENT"),
    (80, "B - GOOD"),
    (70, "C - ACCEPTABLE"),
    (60, "D - POOR"),
    (0, "F - UNACCEPTABLE"),
]
NO_MISSING = "No missing data detected. Dataset is complete."
CRITICAL_MISSING = "CRITICAL: Some columns have >50% missing data. Consider removing these columns."
MUCH_MISSING = "WARNING: Significant missing data detected. Use imputation or consider impact on model."
LITTLE_MISSING = "Minor missing data detected. Simple imputation should suffice."

BROADCAST_HASHES = 1_000_000


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# ---------------------------------------------------------------- missing values


def missing_by_column(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Null count and share per column; ``only_missing`` leaves out complete columns."""
    names = df.columns
    out = per_column(
        df, names, "n_missing bigint, n_rows bigint",
        lambda c: {"n_missing": F.count_if(value(df, c).isNull()), "n_rows": F.count(F.lit(1))},
    ).select("column", "n_missing", F.coalesce(pct(F.col("n_missing"), F.col("n_rows")), F.lit(0.0)).alias("pct_missing"))
    if only_missing:
        out = out.where(F.col("n_missing") > 0)
    return out


def _null_flags(df: DataFrame) -> list[Column]:
    return [value(df, c).isNull().cast("int") for c in df.columns]


def missing_overall(df: DataFrame) -> DataFrame:
    """Missing cells over the whole table, and how many rows are complete."""
    nulls = reduce(lambda a, b: a + b, _null_flags(df))
    return (
        df.select(nulls.alias("nulls"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_cells_missing"),
            F.count_if(F.col("nulls") == 0).alias("n_complete"),
            F.count_if(F.col("nulls") > 0).alias("n_incomplete"),
        )
        .select(
            "n_rows", "n_cells_missing",
            F.coalesce(pct(F.col("n_cells_missing"), F.col("n_rows") * len(df.columns)), F.lit(0.0)).alias("pct_missing"),
            "n_complete", "n_incomplete",
        )
    )


def missing_pattern(df: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent combinations of null columns, as a text of 0 and 1."""
    pattern = F.concat(*[flag.cast("string") for flag in _null_flags(df)])
    return (
        df.groupBy(pattern.alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "pattern")
        .limit(k)
    )


def na_tokens_found(raw: DataFrame, na_vocab: str = "rich") -> DataFrame:
    """Which null tokens occur in which text column; the empty text is not listed."""
    names = _text_columns(raw)
    if not names:
        return raw.sparkSession.createDataFrame([], "column string, token string")
    listed = [t for t in tokens(na_vocab) if t != ""]
    kept = raw.select(*[F.when(col(c).isin(listed), col(c)).alias(c) for c in names])
    return (
        kept.unpivot([], [col(c) for c in names], "column", "token")
        .where(F.col("token").isNotNull())
        .distinct()
    )


def missing_recommendation(df: DataFrame) -> DataFrame:
    worst = F.max("pct_missing")
    return missing_by_column(df).agg(
        F.when(worst == 0, NO_MISSING)
        .when(worst > 50, CRITICAL_MISSING)
        .when(worst > 20, MUCH_MISSING)
        .otherwise(LITTLE_MISSING)
        .alias("recommendation")
    )


# ------------------------------------------------------------ suspicious contents


def _reads_as_number(c: Column) -> Column:
    """Only digits are left once the first point and the first dash are taken away."""
    without_point = F.regexp_replace(c, r"^([^.]*)\.", "$1")
    without_dash = F.regexp_replace(without_point, r"^([^-]*)-", "$1")
    return without_dash.rlike(r"^[0-9]+$")


def type_inconsistency(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Texts that read as numbers against other texts, per text column."""
    names = _text_columns(df) if columns is None else list(columns)
    return per_column(
        df, names, "n_numeric bigint, n_string bigint",
        lambda c: {
            "n_numeric": F.count_if(_reads_as_number(col(c))),
            "n_string": F.count_if(~_reads_as_number(col(c))),
        },
    ).withColumn("mixed", (F.col("n_numeric") > 0) & (F.col("n_string") > 0))


def mixed_type_samples(df: DataFrame, k: int = 5) -> DataFrame:
    """Up to k of the non-numeric texts of every column that mixes both kinds."""
    names = _text_columns(df)
    mixed = type_inconsistency(df, names).where("mixed").select("column")
    # only the texts in question are counted, and k of them per column and task are shuffled
    others = df.select(*[F.when(~_reads_as_number(col(c)), col(c)).alias(c) for c in names])
    return sample_values(others, k, names).join(F.broadcast(mixed), "column", "left_semi")


def single_char_values(df: DataFrame) -> DataFrame:
    """Texts of one character (after trimming) that occur more than once."""
    names = _text_columns(df)
    single = long_values(df, names, "value", "string", lambda c: value(df, c)).where(
        F.length(F.regexp_replace("value", r"^\s+|\s+$", "")) == 1
    )
    found = single.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    found = found.withColumn("pct", pct(F.col("n"), row_count(df)))
    return found.select(
        "column", F.format_string("Single character '%s'", "value").alias("pattern"), "n", "pct"
    )


def blank_strings(raw: DataFrame) -> DataFrame:
    """Texts of only white space, for a table that has not been cleaned yet."""
    out = per_column(
        raw, _text_columns(raw), "n bigint, n_rows bigint",
        lambda c: {"n": F.count_if(col(c).rlike(BLANK)), "n_rows": F.count(F.lit(1))},
    )
    return out.where(F.col("n") > 0).select(
        "column", F.lit("Whitespace/empty strings").alias("pattern"), "n",
        pct(F.col("n"), F.col("n_rows")).alias("pct"),
    )


def sentinel_numbers(df: DataFrame) -> DataFrame:
    """Numbers that usually stand for "unknown", per numeric column."""
    found = (
        long_numbers(df, numeric_columns(df))
        .where(F.col("x").isin(SENTINELS))
        .groupBy("column", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return found.select(
        "column", F.format_string("Suspicious numeric value %d", F.col("x").cast("bigint")).alias("pattern"),
        "n", pct(F.col("n"), row_count(df)).alias("pct"),
    )


def suspicious_patterns(df: DataFrame) -> DataFrame:
    return single_char_values(df).unionByName(sentinel_numbers(df))


def column_issue_report(raw: DataFrame, na_vocab: str = "rich", typed: bool = True) -> DataFrame:
    """Every column with something wrong, and what, in one message.

    Null tokens and blank texts become null first; ``typed`` then turns text columns
    of numbers into numbers, as reading them from a text file would.
    """
    tokens_found = na_tokens_found(raw, na_vocab)
    df = null_tokens(raw, na_vocab)
    if typed:
        df = infer_types(df)
    df = blank_to_null(df)

    missing = missing_by_column(df)
    found = tokens_found.groupBy("column").agg(F.array_join(F.sort_array(F.collect_set("token")), ", ").alias("tokens"))
    mixed = type_inconsistency(df)
    texts = suspicious_patterns(df).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_patterns"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pattern", "n", "pct"))),
                lambda p: F.format_string("%s: %d occurrences (%.2f%%)", p["pattern"], p["n"], p["pct"]),
            ),
            " | ",
        ).alias("patterns"),
    )
    n_patterns = F.coalesce("n_patterns", F.lit(0))
    is_mixed = F.coalesce("mixed", F.lit(False))
    missing_text = F.format_string("Missing values: %d (%.2f%%)", "n_missing", "pct_missing")
    issues = F.concat_ws(
        " | ",
        F.when(is_mixed, F.format_string("Mixed types: %d numeric, %d string", "n_numeric", "n_string")),
        F.col("patterns"),
        F.when(
            F.col("n_missing") > 0,
            F.when(F.col("tokens").isNotNull(), F.concat(missing_text, F.lit(" - Detected as NA: ["), "tokens", F.lit("]")))
            .otherwise(missing_text),
        ),
    )
    return (
        missing.join(F.broadcast(found), "column", "left")
        .join(F.broadcast(mixed), "column", "left")
        .join(F.broadcast(texts), "column", "left")
        .where((F.col("n_missing") > 0) | is_mixed | (n_patterns > 0))
        .select(
            "column", "n_missing", "pct_missing", is_mixed.alias("mixed"),
            n_patterns.alias("n_patterns"), issues.alias("issues"),
        )
    )


# ------------------------------------------------------------------- duplicates


def _row_hash(df: DataFrame) -> Column:
    """64 bits per row. Nulls leave a hash unchanged, so their positions are hashed too."""
    cells = [value(df, c) for c in df.columns]
    mask = F.concat(*[c.isNull().cast("string") for c in cells])
    return F.xxhash64(*cells, mask)


def repeated_rows(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their count ``n_copies``.

    Whole rows are not shuffled: first only their 64-bit hashes are counted, which
    collapses a row with very many copies on the map side. Only rows whose hash
    repeats are then compared in full, so hash collisions cannot matter. The
    repeated hashes are broadcast up to a checked number, else joined by shuffle.
    """
    hashed = df.withColumn("__hash", _row_hash(df))
    repeated = (
        hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("__hash").persist()
    )
    n_repeated = repeated.count()
    if n_repeated == 0:
        candidates = df.limit(0)
    else:
        side = F.broadcast(repeated) if n_repeated <= BROADCAST_HASHES else repeated
        candidates = hashed.join(side, "__hash", "left_semi").drop("__hash")
    clean = candidates.select(*[value(candidates, c).alias(c) for c in df.columns])
    return (
        clean.groupBy(*[col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("n_copies"))
        .where(F.col("n_copies") > 1)
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls equal each other."""
    extra = repeated_rows(df).agg(F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("n_duplicates"))
    return extra.select(
        row_count(df).alias("n_rows"), "n_duplicates",
        F.coalesce(pct(F.col("n_duplicates"), row_count(df)), F.lit(0.0)).alias("pct"),
    )


# -------------------------------------------------------- columns with odd content


def table_profile(df: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The table as a whole: its size, missing cells and repeated rows (``duplicates``, if at hand)."""
    missing, repeated = missing_overall(df), duplicates(df) if repeated is None else repeated
    return missing.crossJoin(repeated.drop("n_rows")).select(  # one row each
        F.lit(len(df.columns)).cast("bigint").alias("n_variables"), F.col("n_rows").alias("n_observations"),
        F.col("n_cells_missing").alias("missing_cells"), F.col("pct_missing").alias("missing_cells_pct"),
        F.col("n_duplicates").alias("duplicate_rows"), F.col("pct").alias("duplicate_rows_pct"),
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct value, nulls aside.

    Equal minimum and maximum mean just that, so no distinct count is needed.
    """
    out = per_column(
        df, flat_columns(df), "n bigint, same boolean",
        lambda c: {"n": F.count(value(df, c)), "same": F.coalesce(F.min(value(df, c)) == F.max(value(df, c)), F.lit(False))},
    )
    return out.where((F.col("n") > 0) & F.col("same")).select("column", F.lit(1).cast("bigint").alias("n_unique"))


def high_cardinality(df: DataFrame, share: float = 0.5, approximate: bool = False) -> DataFrame:
    """Text columns with more distinct values than half the rows."""
    counted = (approx_distinct_counts if approximate else distinct_counts)(df, string_columns(df))
    return counted.where(F.col("n_unique") > row_count(df) * share)


def iqr_outliers(df: DataFrame, factor: float = 1.5, direct_rows: int | None = None) -> DataFrame:
    """Numeric columns with values strictly outside the whiskers, and how many.

    The quartiles come first (a few numbers per column), then one grouped count has
    them as constants.
    """
    limits = {} if direct_rows is None else {"direct_rows": direct_rows}
    found = exact_quantiles(df, numeric_columns(df), [0.25, 0.75], **limits)
    known = {c: q for c, q in found.items() if q is not None}

    def outside(c: str) -> Column:
        q1, q3 = known[c]
        whisker = factor * (q3 - q1)
        x = number(df, c)
        return (x < F.lit(q1 - whisker)) | (x > F.lit(q3 + whisker))

    counted = (
        long_values(df, list(known), "outside", "boolean", outside)
        .groupBy("column")
        .agg(F.count_if("outside").alias("n_outliers"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_outliers") > 0)
    )
    bounds = quantile_frame(df, known, ["q1", "q3"])
    return counted.join(F.broadcast(bounds), "column").select(
        "column", "q1", "q3", "n_outliers", pct(F.col("n_outliers"), F.col("n_rows")).alias("pct")
    )


# ------------------------------------------------------------------ overall grades


def quality_flag(
    df: DataFrame, repeated: DataFrame | None = None, constant: DataFrame | None = None, many: DataFrame | None = None
) -> DataFrame:
    """GOOD without duplicates, constant columns or high cardinality; outliers do not count.

    What is already computed of these can be given.
    """
    repeated = duplicates(df) if repeated is None else repeated
    constant = constant_columns(df) if constant is None else constant
    many = high_cardinality(df) if many is None else many
    found = (
        repeated.select((F.col("n_duplicates") > 0).cast("bigint").alias("issue"))
        .unionAll(constant.agg((F.count(F.lit(1)) > 0).cast("bigint").alias("issue")))
        .unionAll(many.agg((F.count(F.lit(1)) > 0).cast("bigint").alias("issue")))
    )
    return found.agg(F.sum("issue").alias("n_issues")).select(
        F.when(F.col("n_issues") == 0, "GOOD").otherwise("NEEDS_ATTENTION").alias("flag"), "n_issues"
    )


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for limit, name in GRADES[1:-1]:
        out = out.when(score >= limit, name)
    return out.otherwise(GRADES[-1][1])


def quality_score(
    df: DataFrame, target: str | None = None, repeated: DataFrame | None = None, missing: DataFrame | None = None
) -> DataFrame:
    """100 minus penalties for missing cells, duplicates, class imbalance and few rows."""
    missing = (missing_overall(df) if missing is None else missing).select("pct_missing", "n_rows")
    dup = (duplicates(df) if repeated is None else repeated).select("pct").scalar()
    imbalance = F.lit(0.0)
    if target is not None:
        classes = (
            df.where(value(df, target).isNotNull())
            .groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.when(F.count(F.lit(1)) >= 2, F.max("n") / F.min("n")).alias("ratio"))
        )
        imbalance = F.coalesce(classes.scalar(), F.lit(1.0))
    parts = missing.select(
        F.least(F.col("pct_missing") * 0.5, F.lit(30.0)).alias("penalty_missing"),
        F.least(dup * 0.3, F.lit(15.0)).alias("penalty_dup"),
        F.greatest(F.least((imbalance - 3.0) * 2.0, F.lit(20.0)), F.lit(0.0)).alias("penalty_imbalance"),
        F.when(F.col("n_rows") < 1000, 10.0).otherwise(0.0).alias("penalty_size"),
    )
    score = F.greatest(
        F.lit(0.0),
        F.lit(100.0) - F.col("penalty_missing") - F.col("penalty_dup") - F.col("penalty_imbalance") - F.col("penalty_size"),
    )
    return parts.select(score.alias("score"), "*").select(
        "score", grade(F.col("score")).alias("grade"), (F.col("score") >= 70).alias("ready"),
        "penalty_missing", "penalty_dup", "penalty_imbalance", "penalty_size",
    )
