"""Files in and out, synthetic rows, the proxy model and whole audits."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import metrics, model, resample
from auditloom.plans.audit import Proxy, audit, audit_findings, write_audit
from auditloom.plans.evaluation import full_evaluation
from auditloom.session import shared_folder
from auditloom.sources import tables


@pytest.fixture
def people(spark):
    """Small table with text, numbers, a null and a rare class."""
    return spark.range(400).select(
        "id",
        F.when(F.col("id") % 17 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "f").otherwise("m").alias("sex"),
        F.when(F.col("id") % 5 == 0, "east").otherwise("west").alias("race"),
        (F.col("id") % 40 + 20).alias("years"),
        (F.col("id") * 0.5).alias("pay"),
        F.when(F.col("id") % 8 == 0, "high").otherwise("low").alias("income"),
    )


def test_csv_is_typed_by_its_vocabulary(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,?,"x, y"\n2,3.5,NA\n,4,z\n')
    plain = tables.read_table(spark, str(path), "plain")
    assert [f.dataType.simpleString() for f in plain.schema] == ["bigint", "string", "string"]
    rich = tables.read_table(spark, str(path), "rich")
    assert [f.dataType.simpleString() for f in rich.schema] == ["bigint", "double", "string"]
    assert sorted(map(tuple, rich.collect()), key=repr) == sorted([(1, None, "x, y"), (2, 3.5, None), (None, 4.0, "z")], key=repr)


@pytest.mark.parametrize("ending", ["parquet", "orc", "json"])
def test_formats_and_views(spark, tmp_path, people, ending):
    path = str(tmp_path / f"t.{ending}")
    people.write.format(ending).save(path)
    assert tables.read_table(spark, path).count() == 400
    people.createOrReplaceTempView("people_view")
    assert tables.read_table(spark, "people_view").count() == 400


def test_reading_starts_no_job_and_moves_no_rows(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(300_000).coalesce(1).write.parquet(path)
    assert "Exchange" not in tables.read_table(spark, path)._jdf.queryExecution().toString()


def test_findings_replace_only_their_own_stage(spark, tmp_path, people):
    one = tables.findings(people.groupBy("race").agg(F.count(F.lit(1)).alias("n")), "quality", "counts", ["race"])
    two = tables.findings(people.groupBy("income").agg(F.count(F.lit(1)).alias("n")), "imbalance", "counts", ["income"])
    path = tables.write_findings(one, str(tmp_path), "r1")
    tables.write_findings(two, str(tmp_path), "r1")
    tables.write_findings(one, str(tmp_path), "r1")
    assert spark.read.parquet(path).groupBy("stage").count().count() == 2
    assert spark.read.parquet(path).count() == 4


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_smote_on_mixed_columns(spark, people):
    clean = people.withColumn("sex", F.coalesce("sex", F.lit("f")))
    out = resample.smote(clean, "id", "income", k=5).cache()
    sizes = {(r["income"], r["synthetic"]): r["count"] for r in out.groupBy("income", "synthetic").count().collect()}
    assert sizes == {("high", False): 50, ("low", False): 350, ("high", True): 300}
    made = out.where("synthetic")
    assert made.where("id is not null").count() == 0
    assert made.select("made_from").distinct().count() == 300 and out.where("not synthetic and made_from is not null").count() == 0
    assert {r[0] for r in made.select("sex").distinct().collect()} <= {"f", "m"}
    assert {f.name: f.dataType for f in out.schema if f.name not in ("synthetic", "made_from")} == {f.name: f.dataType for f in people.schema}
    low, high = clean.where("income = 'high'").agg(F.min("pay"), F.max("pay")).first()
    assert made.where(~F.col("pay").between(low, high)).count() == 0


def test_smote_decodes_null_text_to_null(spark):
    df = spark.range(60).select("id", F.lit(None).cast("string").alias("t"), (F.col("id") * 1.0).alias("x"), F.when(F.col("id") < 20, 1).otherwise(0).alias("y"))
    made = resample.smote(df, "id", "y").where("synthetic")
    assert made.count() == 20 and made.where("t is not null").count() == 0


def test_smote_refuses_what_it_cannot_do(spark, people):
    with pytest.raises(ValueError, match="neighbours"):
        resample.smote(people.where("income = 'low' or id < 30"), "id", "income", k=5)
    with pytest.raises(ValueError, match="nulls"):
        resample.smote(people.withColumn("pay", F.when(F.col("id") > 3, F.col("pay"))), "id", "income")


def test_synthetic_points_lie_between_rows_of_one_class(spark):
    df = spark.range(120).select(
        "id", F.array((F.col("id") % 11).cast("double"), (F.col("id") % 7).cast("double")).alias("v"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("y")
    )
    made = resample.synthetic_vectors(df, "id", "v", "y", k=3, block_rows=8)
    rows = {r["id"]: (r["v"], r["y"]) for r in df.collect()}
    found = made.collect()
    assert len(found) == 60
    for r in found:
        (a, ya), (b, yb) = rows[r["base_key"]], rows[r["neighbour_key"]]
        assert ya == yb == r["label"] == "a"
        for p, q, x in zip(a, b, r["features"]):
            assert min(p, q) - 1e-9 <= x <= max(p, q) + 1e-9


def test_features_are_coded_and_filled(spark, people):
    out = model.encode_features(people.withColumn("pay", F.when(F.col("id") != 0, F.col("pay"))), "income", ["id"])
    got = out.where("id = 0").first()
    # Missing < f < m; the median of 0.5 .. 199.5
    assert (got["sex"], got["race"], got["pay"], got["target_code"]) == (0.0, 0.0, 100.0, 0.0)


def test_exact_split_takes_the_rounded_share_of_each_class(spark, people):
    out = model.stratified_split(people, ["id"], "income", exact=True)
    got = {r["income"]: r["n"] for r in out.where("is_test").groupBy("income").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"high": 13, "low": 88}
    assert out.count() == 400


@pytest.mark.parametrize("kind", [model.FOREST, model.BOOSTING, model.LOGISTIC, model.SVM])
def test_models_learn_a_clear_rule(spark, kind):
    df = spark.range(600).select("id", (F.col("id") % 100).alias("x"), F.when(F.col("id") % 100 < 50, "a").otherwise("b").alias("y"), F.lit(1.0).alias("w"))
    out = model.train_and_predict(df, ["id"], "y", kind, {"n_estimators": 5, "max_depth": 3}, weight="w")
    assert metrics.classification_summary(out, "y", "yhat").first()["accuracy"] > 0.8


@pytest.mark.parametrize("kind", [model.BOOSTING, model.SVM])
def test_three_classes_go_one_against_the_rest(spark, kind):
    df = spark.range(450).select("id", (F.col("id") % 90).alias("x"), F.floor((F.col("id") % 90) / 30).cast("string").alias("y"))
    out = model.train_and_predict(df, ["id"], "y", kind, {"n_estimators": 3})
    assert {r[0] for r in out.select("yhat").distinct().collect()} <= {"0", "1", "2"}
    assert out.where("yhat is null").count() == 0


def test_an_audit_with_model_and_all_treatments(spark, people, tmp_path):
    clean = people.withColumn("sex", F.coalesce("sex", F.lit("f")))
    results = audit(
        clean, "id", "income", ["sex", "race", "income"], methods=tables.METHODS, proxy=Proxy("Random Forest", {"n_estimators": 5, "max_depth": 3})
    )
    path = write_audit(results, str(tmp_path), "run")
    stages = {r["stage"] for r in spark.read.parquet(path).select("stage").distinct().collect()}
    assert {"load", "quality", "attributes", "imbalance", "target_fairness", "comparison"} <= stages
    assert {f"comparison_{m}" for m in tables.METHODS} <= stages


def test_an_audit_can_guess(spark, people):
    results = audit(people, "id")
    rates = next(r for r in results if r.operator == "target_rates_by_group").frame
    assert {r["attr"] for r in rates.collect()} == {"sex", "race"}


def test_an_audit_without_sensitive_columns(spark, people):
    results = audit(people.select("id", "pay", "income"), "id", "income", [])
    assert audit_findings(results).count() > 0


def test_full_evaluation_covers_all_sections(spark, people):
    sections = {r.stage for r in full_evaluation(people, "income", ["sex", "race"])}
    assert len(sections) == 11
