"""The numbered queries over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import alignment, decontaminate, fingerprints, language, licenses, neardup, packing, pii, quality, repeats, secret_scan, topk, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The file of a tokenizer (the byte-level one), as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("found", lambda f: f["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")
    ]
    base = _joined(F.filter("found", lambda f: f["kind"] != "named"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    sums = language.prototypes(docs, fold != 1)
    predicted = language.identify(docs, sums)
    return predicted.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    spans = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)).alias("best_coverage"),
    )


#: In production the key comes from a secret store; it decides which pseudonyms come out.
PII_KEY = "key of the checked queries"


@query
def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_values(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", F.size("found").cast("long").alias("n_values"), _joined(F.col("found")).alias("spans"), "text")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer(), marked=True)


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignments(table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv").cast("string")) % 9
    return trie.tree_of_families(table(spark, sf_dir, "conversations"), heads, longest=8, family=5)
