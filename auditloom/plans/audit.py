"""The staged audit: quality, attributes, imbalance, fairness, treatment, comparison.

A stage is a set of named results over one input. Building them runs some jobs: quality
screens look at the data to choose their plans, the proxy is trained, and treated tables
are written. The results themselves are lazy and each reads the input, so its rows are settled
first: a view's joins are made once, not by every result.

``audit`` builds all stages. ``run_audit`` builds and writes one after the other, and where it
was ended goes on: findings, predictions and treated tables are kept under a digest of the
input's rows and of the settings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache, partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import balance, compare, fairness, metrics, profile, quality, resample
from auditloom.operators.catalog import SENSITIVE_WORDS, TARGET_NAMES, catalog_of, sensitive_by_keyword
from auditloom.operators.model import FOREST, train_and_predict
from auditloom.plans.kept import Kept, table_fingerprint
from auditloom.session import settled, shared_folder
from auditloom.sources.nulls import blank_to_null, complete_cases, null_tokens
from auditloom.sources.tables import findings, write_findings

SAMPLES = 10


@dataclass
class Result:
    stage: str
    operator: str
    frame: DataFrame
    subject: list[str] = field(default_factory=list)


@dataclass
class Proxy:
    """How the proxy model is trained; the same one serves before and after."""

    model_type: str = FOREST
    params: dict | None = None
    test_share: float = 0.25
    exact_split: bool = True


def guessed_target(df: DataFrame) -> str:
    named = [c for c in df.columns if c.lower() in TARGET_NAMES]
    return named[0] if named else df.columns[-1]


def guessed_sensitive(df: DataFrame, target: str | None) -> list[str]:
    hits = [c for c in df.columns if any(w in c.lower() for w in SENSITIVE_WORDS)]
    return fairness.without_target(hits, target)


def _flagged(df: DataFrame) -> DataFrame:
    return sensitive_by_keyword(catalog_of(df.sparkSession, {"table": df})).withColumn("flagged", F.lit(True))


def treated(df: DataFrame, method: str, key: str, target: str, sensitive: Sequence[str], strategy: str = "auto", k: int = 5) -> DataFrame:
    """One treatment by name."""
    if method == "reweighted":
        return resample.reweight(df, target, sensitive)
    if method == "oversampled":
        return resample.oversample(df, [key], target, strategy)
    if method == "undersampled":
        return resample.undersample(df, [key], target, strategy)
    if method == "smote":
        return resample.smote(df, key, target, k, strategy)
    raise ValueError(f"unknown method: {method}")


def audit(
    df: DataFrame,
    key: str,
    target: str | None = None,
    sensitive: Sequence[str] | None = None,
    selected_pairs: Sequence[tuple[str, str]] | None = None,
    methods: Sequence[str] = (),
    proxy: Proxy | None = None,
    strategy: str = "auto",
    folder: str | None = None,
) -> list[Result]:
    """Runs the stages and returns their results, not yet computed.

    Given ``target`` and ``sensitive`` replace the guesses; the target never counts
    as sensitive. Treated tables are written to ``folder`` (by default below the
    session's shared folder) and compared as read back from there.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/treated-{uuid.uuid4().hex}"
    df = settled(df)
    stages = audit_stages(df, Kept(df, folder, resume=False), key, target, sensitive, selected_pairs, methods, proxy, strategy)
    return [result for stage in stages.values() for result in stage()]


def run_audit(
    df: DataFrame,
    key: str,
    folder: str,
    target: str | None = None,
    sensitive: Sequence[str] | None = None,
    selected_pairs: Sequence[tuple[str, str]] | None = None,
    methods: Sequence[str] = (),
    proxy: Proxy | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """The findings of an audit, written stage by stage below ``folder``.

    A stage whose findings are there for the same rows, in any order, and the same settings
    is not run again; nor is a model trained or a treatment made twice. Changed rows or
    settings start a run of their own.
    """
    settings = repr((key, target, None if sensitive is None else list(sensitive), selected_pairs, list(methods), proxy, strategy))
    run_id = "run-" + hashlib.sha256(f"{table_fingerprint(df)} {settings}".encode()).hexdigest()[:32]
    kept = Kept(df, f"{folder.rstrip('/')}/runs/{run_id}", resume=True)
    given = df
    df = kept.table("input", lambda: given)
    stages = audit_stages(df, kept, key, target, sensitive, selected_pairs, methods, proxy, strategy)
    path = f"{folder.rstrip('/')}/findings"
    for name, stage in stages.items():
        if f"findings of {name}" not in kept.finished:
            path = write_findings(audit_findings(stage()), folder, run_id)
            kept.mark(f"findings of {name}")
    return df.sparkSession.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def audit_stages(
    df: DataFrame,
    kept: Kept,
    key: str,
    target: str | None = None,
    sensitive: Sequence[str] | None = None,
    selected_pairs: Sequence[tuple[str, str]] | None = None,
    methods: Sequence[str] = (),
    proxy: Proxy | None = None,
    strategy: str = "auto",
) -> dict[str, Callable[[], list[Result]]]:
    """The stages in order, each a function that builds its results when called."""
    target = target or guessed_target(df)
    sensitive = fairness.without_target(sensitive, target) if sensitive is not None else guessed_sensitive(df, target)
    n_columns = len(df.columns)

    @cache
    def positive():
        # the class is that of the whole target, whatever classes the test rows hold
        first = df.select(metrics.positive_label(df.select(target), target).alias("p")).first() if proxy else None
        return first["p"] if first else None

    def predictions() -> DataFrame:
        return kept.table("predictions", lambda: _predictions(blank_to_null(null_tokens(df, "rich")), [key], target, sensitive, proxy))

    def after(method: str) -> DataFrame:
        return kept.table(f"method={method}", lambda: treated(df, method, key, target, sensitive, strategy))

    def imbalance() -> list[Result]:
        out = [Result("imbalance", "dominant_values", balance.dominant_values(df, sensitive), ["column", "rank"])]
        return out + (_proxy_results(predictions(), sensitive, positive()) if proxy else [])

    def target_fairness() -> list[Result]:
        out = _target_fairness(df, target, sensitive, selected_pairs)
        column_pairs = fairness.pairs(df, sensitive, selected_pairs) if proxy else []
        if column_pairs:
            both = metrics.group_metrics(predictions(), column_pairs, "y", "yhat", positive())
            out.append(Result("target_fairness", "intersectional_group_metrics", both, ["attr", "grp"]))
        return out

    def comparison(method: str) -> list[Result]:
        stage = f"comparison_{method}"
        out = _comparison(df, after(method), stage, target, sensitive)
        if proxy:
            weight = resample.WEIGHT if resample.WEIGHT in after(method).columns else None
            again = kept.table(
                f"predictions_{method}",
                lambda: _predictions(_fresh_key(after(method), key, method), [key], target, sensitive, proxy, weight),
            )
            effect = compare.compare_fairness(*[_parity(p, sensitive, positive()) for p in (predictions(), again)])
            out += [
                Result(stage, "compare_fairness", effect, ["attr"]),
                Result(stage, "fairness_effect", compare.fairness_effect(effect)),
            ]
        return out

    def ranking() -> list[Result]:
        rows = [compare.compare_imbalance(df, after(m), target, m) for m in methods]
        return [Result("comparison", "rank_methods", compare.rank_methods(rows), ["method"])]

    stages: dict[str, Callable[[], list[Result]]] = {
        "load": lambda: [Result("load", "size", df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(n_columns).alias("n_columns")))],
        "quality": lambda: [Result("quality", "column_issue_report", quality.column_issue_report(df), ["column"])],
        "attributes": lambda: [
            Result("attributes", "column_catalog", profile.column_catalog(df), ["column", "rank"]),
            Result("attributes", "sample_values", profile.sample_values(df, SAMPLES), ["column", "rank"]),
            Result("attributes", "sensitive_by_keyword", _flagged(df), ["table_name", "column"]),
        ],
        "imbalance": imbalance,
    }
    if sensitive:
        stages["target_fairness"] = target_fairness
    for method in methods:
        stages[f"comparison_{method}"] = partial(comparison, method)
    if methods:
        stages["comparison"] = ranking
    return stages


def _predictions(df, key, target, sensitive, proxy: Proxy, weight: str | None = None) -> DataFrame:
    return train_and_predict(
        df, key, target, proxy.model_type, proxy.params, proxy.test_share, weight=weight, carry=sensitive, exact_split=proxy.exact_split
    )


def _parity(predicted: DataFrame, sensitive, positive) -> DataFrame:
    return metrics.prediction_parity(metrics.group_metrics(predicted, list(sensitive), "y", "yhat", positive))


def _proxy_results(predicted: DataFrame, sensitive, positive) -> list[Result]:
    by_group = metrics.group_metrics(predicted, list(sensitive), "y", "yhat", positive)
    return [
        Result("imbalance", "classification_summary", metrics.classification_summary(predicted, "y", "yhat")),
        Result("imbalance", "classification_report", metrics.classification_report(predicted, "y", "yhat"), ["label"]),
        Result("imbalance", "confusion_matrix", metrics.confusion_matrix(predicted, "y", "yhat"), ["actual", "predicted"]),
        Result("imbalance", "group_metrics", by_group, ["attr", "grp"]),
        Result("imbalance", "prediction_parity", metrics.prediction_parity(by_group), ["attr"]),
        Result("imbalance", "error_rate_ratios", metrics.error_rate_ratios(by_group), ["attr"]),
    ]


def _target_fairness(df, target, sensitive, selected_pairs) -> list[Result]:
    if not sensitive:
        return []
    complete = complete_cases(null_tokens(df, "rich"))
    out = [
        Result("target_fairness", "target_distribution", fairness.group_proportions(complete, [target]), ["attr", "value"]),
        Result("target_fairness", "group_proportions", fairness.group_proportions(complete, sensitive), ["attr", "value"]),
        Result("target_fairness", "target_rates_by_group", fairness.target_rates_by_group(complete, sensitive, target), ["attr", "grp", "label"]),
    ]
    column_pairs = fairness.pairs(complete, sensitive, selected_pairs)
    if column_pairs:
        out += [
            Result("target_fairness", "intersectional_rates", fairness.intersectional_rates(complete, column_pairs, target), ["attr", "grp", "label"]),
            Result("target_fairness", "scale_buckets", fairness.scale_buckets(complete, column_pairs), ["attr", "grp"]),
            Result("target_fairness", "pair_proportions", fairness.pair_proportions(complete, column_pairs), ["attr", "value"]),
            Result("target_fairness", "top_combinations", fairness.top_combinations(complete, column_pairs, target), ["attr", "grp", "label"]),
        ]
    return out


def _comparison(df: DataFrame, after: DataFrame, stage: str, target: str, sensitive: Sequence[str]) -> list[Result]:
    weighted = resample.WEIGHT in after.columns
    by_class = compare.compare_target_weighted if weighted else compare.compare_target
    out = [
        Result(stage, "compare_size", compare.compare_size(df, after)),
        Result(stage, "compare_target", by_class(df, after, target), ["label"]),
        Result(stage, "compare_sensitive", compare.compare_sensitive(df, after, sensitive), ["attr", "value"]),
        Result(stage, "mitigation_summary", resample.mitigation_summary(df, after, target), ["label"]),
    ]
    if weighted:
        out += [
            Result(stage, "weight_stats", resample.weight_stats(after)),
            Result(stage, "weighted_distribution", resample.weighted_distribution(after, target), ["label"]),
        ]
    return out


def _fresh_key(after: DataFrame, key: str, method: str) -> DataFrame:
    """A text key that is unique again after rows were repeated or made up."""
    if method == "oversampled":
        new = F.concat_ws("-", F.col(key), F.col("draw"))
        return after.withColumn(key, new).drop("draw")
    if method == "smote":
        made = F.concat_ws("-", F.lit("made"), F.col("made_from"))
        same = after.withColumn(key, F.when(F.col("synthetic"), made).otherwise(F.col(key).cast("string")))
        return same.drop("synthetic", "made_from")
    extra = [c for c in (resample.GROUP,) if c in after.columns]
    return after.drop(*extra)


def audit_findings(results: Sequence[Result], stages: Sequence[str] | None = None) -> DataFrame:
    """All results in long form, ready to be written by run and stage."""
    kept = [r for r in results if stages is None or r.stage in stages]
    return reduce(DataFrame.unionByName, [findings(r.frame, r.stage, r.operator, r.subject) for r in kept])


def write_audit(results: Sequence[Result], folder: str, run_id: str) -> str:
    """Writes the findings stage by stage, so that no plan spans the whole audit."""
    path = ""
    for stage in dict.fromkeys(r.stage for r in results):
        path = write_findings(audit_findings(results, [stage]), folder, run_id)
    return path
