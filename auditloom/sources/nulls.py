"""Null tokens in text, blank strings, typing of text columns, incomplete rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import col, value

# Texts that stand for a missing value, matched exactly.
PLAIN_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
EVALUATOR_TOKENS = ["?", "NA", "N/A", "", "null", "NULL"]
RICH_TOKENS = [
    "?", "NA", "N/A", "n/a", "na", "NULL", "null", "None", "none", "", " ", "NaN", "nan",
    "--", "..", "missing", "Missing", "unknown", "Unknown", "UNKNOWN", "undefined", "Undefined",
]

VOCABULARIES = {
    "plain": PLAIN_TOKENS,
    "evaluator": sorted({*PLAIN_TOKENS, *EVALUATOR_TOKENS}),
    "rich": sorted({*PLAIN_TOKENS, *RICH_TOKENS}),
}

BLANK = r"^\s*$"
WHOLE = r"^[+-]?[0-9]+$"
REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def tokens(na_vocab: str) -> list[str]:
    return VOCABULARIES[na_vocab]


def _map_text(df: DataFrame, change) -> DataFrame:
    return df.select(
        *[
            change(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def null_tokens(df: DataFrame, na_vocab: str = "plain") -> DataFrame:
    """Every text that is exactly one of the vocabulary's tokens becomes null."""
    listed = tokens(na_vocab)
    return _map_text(df, lambda c: F.when(~c.isin(listed), c))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Texts of nothing but white space become null."""
    return _map_text(df, lambda c: F.when(~c.rlike(BLANK), c))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[value(df, c).alias(c) for c in df.columns])



def infer_types(df: DataFrame) -> DataFrame:
    """Text columns in which every non-null text parses become bigint or double.

    One aggregate over all text columns decides; a column without any value stays
    text. The cast itself is a projection, so it runs inside the next stage.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    checks = []
    for i, c in enumerate(text):
        trimmed = F.trim(col(c))
        checks += [
            F.count(col(c)).alias(f"n_{i}"),
            F.count_if(trimmed.rlike(REAL)).alias(f"real_{i}"),
            F.count_if(trimmed.rlike(WHOLE) & trimmed.try_cast("bigint").isNotNull()).alias(f"whole_{i}"),
        ]
    found = df.agg(*checks).first()
    target: dict[str, str] = {}
    for i, c in enumerate(text):
        if found[f"n_{i}"] and found[f"n_{i}"] == found[f"real_{i}"]:
            target[c] = "bigint" if found[f"n_{i}"] == found[f"whole_{i}"] else "double"
    return df.select(
        *[F.trim(col(c)).cast(target[c]).alias(c) if c in target else col(c) for c in df.columns]
    )


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without any null, over all columns."""
    return nan_to_null(df).dropna("any")


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(value(df, target).isNotNull())
