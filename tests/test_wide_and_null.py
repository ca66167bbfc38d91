"""All columns count, nulls are told apart, and models score each test row once."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions.hashing import keyed_md5
from auditloom.operators import catalog, fairness, metrics, model, neighbors, profile, resample, stats
from auditloom.plans.audit import _fresh_key
from auditloom.session import settled, shared_folder


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(60).select("id", *[(F.col("id") * k + k).alias(f"c{k}") for k in range(1, 30)])


def test_profiles_and_screens_take_all_columns(wide):
    assert profile.auto_profile(wide).count() == 30
    assert stats.normality_screen(wide).count() == 30 and stats.variation_risk(wide).count() == 30


def test_smallest_samples_are_by_size(spark):
    df = spark.createDataFrame([(x, str(x)) for x in (100, -5, 10, 3, 2)], "n long, t string")
    got = {c: [r["value"] for r in profile.sample_values(df, 3).where(F.col("column") == c).orderBy("rank").collect()] for c in ("n", "t")}
    assert got == {"n": ["-5", "2", "3"], "t": ["-5", "10", "100"]}


def test_flagged_nested_columns_are_kept(spark):
    df = spark.createDataFrame([([1.0], 1), (None, 2)], "age array<double>, x int")
    flagged = catalog.sensitive_by_keyword(catalog.catalog_of(spark, {"t": df}))
    (row,) = catalog.flagged_column_facts({"t": df}, flagged).collect()
    assert (row["column"], row["n_rows"], row["n_null"], row["n_unique"]) == ("age", 2, 1, None)


def test_null_parts_of_a_key_are_told_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(keyed_md5(F.col("x"), F.col("y")).alias("d")).distinct().count() == 3


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_too_deep_trees_are_refused():
    with pytest.raises(ValueError, match="max_depth"):
        model.classifier(model.FOREST, {"max_depth": 50}, 10, 2, None)


def test_group_statistics_shuffle_groups_and_labels_only(spark):
    df = spark.range(1000).select(*[(F.col("id") % k).alias(f"c{k}") for k in (2, 3, 5, 7)], (F.col("id") % 2).alias("y"))
    plan = fairness.intersectional_rates(df, [("c2", "c3"), ("c5", "c7")], "y")._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "HashAggregate(keys=[" in line]
    assert keys and all("c2" not in k and "c5" not in k for k in keys)


def test_synthetic_rows_of_equal_content_are_scored_once_each(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 3), int(i % 10 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, v double, y int")
    numbered = settled(_fresh_key(resample.smote(df, "id", "y", k=5), "id", "smote"))
    assert numbered.select("id").distinct().count() == numbered.count()
    scored = model.train_and_predict(numbered, ["id"], "y", model.LOGISTIC, {"max_iter": 5}, carry=["g"], exact_split=True)
    n_test = model.stratified_split(numbered, ["id"], "y", exact=True).where("is_test").count()
    assert scored.count() == n_test == scored.select("id").distinct().count()
    assert scored.where("g is null").count() == 0


def test_a_class_missing_from_the_test_rows_does_not_move_the_positive_class(spark):
    cells = spark.createDataFrame([("g", "b", "b"), ("g", "c", "b"), ("g", "c", "c")], "g string, y string, yhat string")
    whole = cells.unionAll(spark.createDataFrame([("h", "a", "a")], cells.schema))
    positive = whole.select(metrics.positive_label(whole, "y").alias("p")).first()["p"]
    rates = [r["base_rate"] for d in (cells, whole) for r in metrics.group_metrics(d, ["g"], "y", "yhat", positive).where("grp = 'g'").collect()]
    assert positive == "b" and rates[0] == rates[1]


def test_neighbours_leave_out_nulls_and_blocks_do_not_matter(spark):
    rows = [(i, [float(i * i % 97), float(i % 13)], "x" if i % 2 else "y") for i in range(150)]
    rows += [(200, None, "x"), (201, [None, 1.0], "x"), (202, [1.0, 1.0], None), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, c string")
    read = lambda **a: sorted(map(tuple, neighbors.nearest_neighbours(df, "id", "v", 4, within="c", **a).collect()))
    whole = read()
    assert whole == read(block_rows=20) and len(whole) == 600
    hashed = {r[:2] for r in read(method="lsh", tables=24, bits=2)}
    assert len(hashed & {r[:2] for r in whole}) >= 0.9 * len(whole)
    with pytest.raises(ValueError, match="method"):
        neighbors.nearest_neighbours(df, "id", "v", 4, method="some")
