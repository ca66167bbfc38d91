"""Reading and writing tables, and the long-form findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import col, row_count
from auditloom.operators.catalog import catalog_of
from auditloom.sources.nulls import infer_types, null_tokens

METHODS = ["reweighted", "smote", "oversampled", "undersampled"]


def read_table(spark: SparkSession, path: str, na_vocab: str = "plain", multi_line: bool = False) -> DataFrame:
    """A catalog table name, or a path to Parquet, ORC, JSON or CSV by its ending.

    CSV is read as text; null tokens are then turned into null and columns of
    numbers into numbers, so the vocabulary decides the types. Large CSV files are split
    among tasks at line ends; ``multi_line`` reads quoted texts that hold line ends, and
    then takes one task per file.
    """
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        text = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
        return infer_types(null_tokens(text, na_vocab))
    if ending in ("parquet", "orc", "json") or "/" in path:
        return spark.read.format(ending if ending in ("orc", "json") else "parquet").load(path)
    return spark.table(path)


def load_summary(df: DataFrame, order_by: list[str], preview: int = 3) -> DataFrame:
    """The first rows by an order, each with the size of the table beside it."""
    shown = df.orderBy(*[col(c) for c in order_by]).limit(preview)
    return shown.select(
        row_count(df).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        *[col(c) for c in df.columns],
    )


def columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column, dtype, kind) from the schemas."""
    return catalog_of(spark, tables)


def write_mitigated(df: DataFrame, folder: str, method: str) -> str:
    """Writes one treated table under ``method=<name>`` and returns its path."""
    path = f"{folder.rstrip('/')}/method={method}"
    df.write.mode("overwrite").parquet(path)
    return path


def inventory_outputs(spark: SparkSession, folder: str, methods: list[str]) -> DataFrame:
    """(method, n_rows, n_columns, has_weights) of the written treatments."""
    parts = None
    for m in methods:
        df = spark.read.parquet(f"{folder.rstrip('/')}/method={m}")
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(m).alias("method"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit("sample_weight" in df.columns).alias("has_weights"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def preview_outputs(spark: SparkSession, folder: str, methods: list[str], order_by: list[str], rows: int = 5) -> DataFrame:
    """(method, rank, row): the first rows of each written treatment by an order, as JSON."""
    parts = None
    for m in methods:
        df = spark.read.parquet(f"{folder.rstrip('/')}/method={m}")
        first = df.orderBy(*[col(c) for c in order_by]).limit(rows)  # each task keeps that many
        ranked = first.withColumn("__rank", F.row_number().over(W.orderBy(*[col(c) for c in order_by])))
        row = ranked.select(F.lit(m).alias("method"), F.col("__rank").alias("rank"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias("row"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def findings(result: DataFrame, stage: str, operator: str, subject: list[str]) -> DataFrame:
    """A result in long form: (stage, operator, subject, metric, value_double, value_string).

    ``subject`` names the columns that say what a row is about; each other column
    becomes one finding per row.
    """
    about = F.concat_ws(" / ", *[F.concat(F.lit(c + "="), F.coalesce(col(c).cast("string"), F.lit("null"))) for c in subject])
    rest = [f for f in result.schema.fields if f.name not in subject]
    metrics = [
        F.struct(
            F.lit(f.name).alias("metric"),
            (col(f.name).cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")).alias("value_double"),
            (F.lit(None).cast("string") if isinstance(f.dataType, T.NumericType) else col(f.name).cast("string")).alias("value_string"),
        )
        for f in rest
    ]
    return result.select(
        F.lit(stage).alias("stage"), F.lit(operator).alias("operator"), about.alias("subject"), F.inline(F.array(*metrics))
    )


def write_findings(df: DataFrame, folder: str, run_id: str) -> str:
    """Appends findings under run_id and stage. A repeated run replaces its own stages."""
    path = f"{folder.rstrip('/')}/findings"
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "stage")
        .parquet(path)
    )
    return path
