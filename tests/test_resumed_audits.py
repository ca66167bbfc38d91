"""Audits that go on where a run was ended, and the digest of a table that tells them apart."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import model
from auditloom.plans import audit as plan
from auditloom.plans.kept import table_fingerprint


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], float(i % 11), "yes" if i % 11 + i % 2 > 6 else "no") for i in range(240)]
    return spark.createDataFrame(rows, "id long, sex string, race string, hours double, income string")


def content(df):
    kept = df.select("stage", "operator", "subject", "metric", F.round("value_double", 6).alias("x"), "value_string")
    return sorted(map(tuple, kept.collect()), key=repr)


def test_the_digest_is_of_rows_not_of_their_order(spark, people):
    first = table_fingerprint(people)
    assert first == table_fingerprint(people.repartition(7, "hours").orderBy(F.desc("id")))
    changed = people.withColumn("race", F.when(F.col("id") == 17, "w").otherwise(F.col("race")))
    others = [changed, people.unionAll(people.where("id = 3")), people.where("id <> 3"), people.withColumnRenamed("sex", "kind"), people.limit(0)]
    assert len({first, *map(table_fingerprint, others)}) == len(others) + 1
    null_first, null_last = (spark.createDataFrame([r], "a string, b string") for r in ((None, "v"), ("v", None)))
    assert table_fingerprint(null_first) != table_fingerprint(null_last)
    nested = spark.sql("SELECT map('k', 1) AS m, array(1, 2) AS a, CAST(NULL AS STRUCT<x: INT>) AS s")
    assert table_fingerprint(nested) == table_fingerprint(nested.repartition(3))


def test_an_ended_audit_goes_on(people, tmp_path, monkeypatch):
    given = {
        "target": "income", "sensitive": ["sex", "race"], "methods": ["undersampled"],
        "proxy": plan.Proxy(model.LOGISTIC, {"max_iter": 5}),
    }

    def fail(*args, **kwargs):
        raise RuntimeError("ended")

    with monkeypatch.context() as ended:
        ended.setattr(plan.compare, "compare_imbalance", fail)
        with pytest.raises(RuntimeError, match="ended"):
            plan.run_audit(people, "id", str(tmp_path), **given)

    with monkeypatch.context() as spared:  # what is finished is not done again
        for module, name in (
            (plan.quality, "column_issue_report"), (plan.profile, "column_catalog"), (plan.balance, "dominant_values"),
            (plan, "train_and_predict"), (plan, "treated"), (plan.fairness, "group_proportions"),
        ):
            spared.setattr(module, name, fail)
        resumed = plan.run_audit(people.repartition(5, "id"), "id", str(tmp_path), **given)
        again = plan.run_audit(people, "id", str(tmp_path), **given)
        with pytest.raises(RuntimeError, match="ended"):  # other rows are another run
            plan.run_audit(people.where("id > 0"), "id", str(tmp_path), **given)
        with pytest.raises(RuntimeError, match="ended"):  # other settings too
            plan.run_audit(people, "id", str(tmp_path), **{**given, "sensitive": ["sex"]})
    whole = content(plan.audit_findings(plan.audit(people, "id", folder=str(tmp_path / "plain"), **given)))
    assert content(resumed) == content(again) == whole
    assert {"load", "quality", "attributes", "imbalance", "target_fairness", "comparison_undersampled", "comparison"} == {r[0] for r in whole}


def test_results_read_settled_rows_instead_of_the_joins_of_a_view(spark):
    left = spark.range(200).selectExpr("id", "id % 3 as g", "id % 2 as y")
    right = spark.range(3).selectExpr("id as g", "concat('group', id) as sex")
    results = plan.audit(left.join(right, "g"), "id", "y", ["sex"])
    size = next(r.frame for r in results if r.operator == "size")
    assert "Join" not in size._jdf.queryExecution().optimizedPlan().toString()
    assert size.first()["n_rows"] == 200
