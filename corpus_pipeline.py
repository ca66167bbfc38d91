"""A training corpus from raw documents, in stages that are each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import decontaminate, neardup, packing, pii, quality, queries
from auditloom.session import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained quality classifier rejects, and without toxic ones.

    A null text counts as empty; a document with a null id is judged like any other; repeated
    rows are judged alike; without labels of both kinds nothing is rejected.
    """
    return quality.accepted(docs, queries.table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (five words, 0.8).

    Empty and null texts and documents with a null id are linked with nothing and stay; rows
    that repeat the kept document's id stay with it.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    dropped = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages.

    Texts without a hit, null and empty ones too, stay as they are; an empty benchmark changes nothing.
    """
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data; null stays null, and equal values get equal pseudonyms everywhere."""
    return pii.pseudonymised(docs, queries.PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; a null or empty text is its end mark alone."""
    return packing.packed(docs, queries.tokenizer(), marked=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("near-duplicates", different),
    ("benchmark decontamination", clean),
    ("personal data", private),
    ("packing", packed),
]

#: The classifier, the tokenizer and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
