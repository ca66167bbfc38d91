"""The kernel machine: what a linear one cannot learn, and probabilities that are right on average."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import kernel, model
from auditloom.operators.kernel import GaussianFeatures, platt, probabilities


@pytest.fixture(scope="module")
def ring(spark):
    """Points inside and outside a ring; near it either label is drawn, as Platt's curve supposes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = rng.random(3000) < 1 / (1 + np.exp(4 * ((x**2).sum(1) - 1.4)))
    rows = [(i, float(a), float(b), "in" if t else "out", "g" + str(i % 2)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y string, g string").repartition(4)


def accuracy(scored):
    return scored.agg(F.avg((F.col("y") == F.col("yhat")).cast("double"))).first()[0]


def test_cosines_give_the_kernel(spark):
    points = spark.createDataFrame([(float(i), float(i * i % 7), 1.0) for i in range(20)], "a double, b double, flat double")
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["a", "b", "flat"], outputCol="features").transform(points)
    kernel = GaussianFeatures(points, "features", 1, gamma=0.3, components=8192)
    got = np.array([r["z"].toArray() for r in kernel.transform(points, "features", "z").orderBy("a").collect()])
    x = np.array([(i, i * i % 7) for i in range(20)], float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    expected = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(got @ got.T - expected).max() < 0.06


def test_a_ring_needs_the_kernel_and_its_scores_are_calibrated(ring):
    linear = model.train_and_predict(ring, ["id"], "y", model.LINEAR_SVM, {"max_iter": 10})
    scored = model.train_and_predict(ring, ["id"], "y", model.SVM, {"max_iter": 20}, carry=["g"], probability=True).persist()
    assert scored.columns == ["id", "y", "yhat", "g", "probability"]
    assert accuracy(scored) > 0.82 > 0.7 > accuracy(linear)
    bins = scored.groupBy(F.floor(F.col("probability") * 5).alias("bin")).agg(
        F.avg("probability").alias("said"), F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("right"), F.count("*").alias("n")
    ).collect()
    assert len(bins) >= 3
    assert sum(r["n"] * abs(r["said"] - r["right"]) for r in bins) / sum(r["n"] for r in bins) < 0.06


def test_the_same_seed_gives_the_same_labels(ring):
    first, other = (
        sorted(map(tuple, model.train_and_predict(ring.repartition(n), ["id"], "y", model.SVM, {"max_iter": 5}).select("id", "yhat").collect()))
        for n in (2, 5)
    )
    assert sum(a != b for a, b in zip(first, other)) <= 3  # sums of doubles differ in their last digits


@pytest.mark.parametrize("kind", [model.SVM, model.BOOSTING, model.LOGISTIC])
def test_three_classes_have_probabilities(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 3 * 4 + rng.normal()), "abc"[i % 3], 1.0 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y string, w double")
    out = model.train_and_predict(df, ["id"], "y", kind, {"n_estimators": 3, "max_iter": 5}, weight="w", probability=True)
    low, n = out.agg(F.min("probability"), F.count_if(F.col("probability") <= 1.0)).first()
    assert low > 0.2 and n == out.count() and accuracy(out) > 0.8


def test_platt_without_rows_or_with_one_class(spark):
    schema = "label double, x double"
    vector = lambda d: model.array_to_vector(F.array(-F.col("x"), F.col("x"))).alias("rawPrediction")
    empty = spark.createDataFrame([], schema)
    assert platt(empty.select("label", vector(empty)), "label", 2) == [(1.0, 0.0)]
    one = spark.createDataFrame([(1.0, float(i)) for i in range(8)], schema)
    fitted = platt(one.select("label", vector(one)), "label", 2)
    p = one.select(vector(one)).select(F.get(probabilities(fitted, 2), F.lit(1)).alias("p"))
    assert all(abs(r["p"] - 0.9) < 0.02 for r in p.collect())  # (8 + 1) / (8 + 2)


def test_training_rows_are_dealt_by_the_size_of_their_cosines(spark):
    rows = spark.range(0, 1000, 1, 1)
    dealt = kernel.spread(rows, components=256, task_bytes=100 * 256 * 8)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 150
    assert kernel.spread(rows).count() == 1000


@pytest.fixture(scope="module")
def coded(ring):
    """The ring with weights, two classes and three."""
    from pyspark.ml.feature import VectorAssembler

    third = F.when((F.col("y") == "in") & (F.col("a") > 0), 2.0).when(F.col("y") == "in", 1.0).otherwise(0.0)
    points = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ring)
    return points.withColumns({"two": (F.col("y") == "in").cast("double"), "three": third, "w": 0.5 + F.col("id") % 3}).persist()


def test_training_holds_no_cosines_and_reads_its_input_once(spark, ring, monkeypatch):
    monkeypatch.setattr(GaussianFeatures, "transform", lambda *_: pytest.fail("cosines are made as rows of a table"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    df = ring.select("id", counted("a").alias("a"), "b", "y")
    scored = model.train_and_predict(df, ["id"], "y", model.SVM, {"max_iter": 3}, probability=True)
    assert scored.count() > 0 and read.value == ring.count()


@pytest.mark.parametrize(("label", "classes", "weight"), [("two", 2, None), ("two", 2, "w"), ("three", 3, "w")])
def test_the_machine_is_the_one_that_spark_trains_over_held_cosines(coded, label, classes, weight):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    gaussian, reg = GaussianFeatures(coded, "features", 3, components=32), 1.0 / coded.count()
    svc = LinearSVC(maxIter=40, regParam=reg, labelCol=label)
    svc = svc.setWeightCol(weight) if weight else svc
    held = gaussian.transform(coded, "features", "features")
    spark_s = (svc if classes == 2 else OneVsRest(classifier=svc, labelCol=label, weightCol=weight)).fit(held)
    ours = kernel.fit_machine(gaussian, coded, classes, reg, 40, "features", label, weight)

    def predicted(scored):
        return np.array([r["prediction"] for r in scored.orderBy("id").collect()])

    assert (predicted(spark_s.transform(held)) == predicted(ours.transform(coded))).mean() > 0.97
    raw = np.array([r["rawPrediction"].toArray() for r in ours.transform(coded).orderBy("id").collect()])
    if classes == 2:  # the loss is as low as Spark's
        rows = held.orderBy("id").collect()
        z, y, w = np.array([r["features"].toArray() for r in rows]), np.array([2 * r[label] - 1 for r in rows]), np.array([r[weight] if weight else 1.0 for r in rows])
        dev = np.sqrt(np.average((z - np.average(z, axis=0, weights=w)) ** 2, axis=0, weights=w))

        def loss(decision, weights):
            return w @ np.maximum(0, 1 - y * decision) / w.sum() + reg / 2 * ((weights * dev) ** 2).sum()

        theirs = loss(z @ spark_s.coefficients.toArray() + spark_s.intercept, spark_s.coefficients.toArray())
        assert loss(raw[:, 1], ours.weights[:, 0]) <= theirs * 1.01


def test_sums_of_many_tasks_are_added_in_tasks(coded, monkeypatch):
    gaussian = GaussianFeatures(coded, "features", 3, components=16)
    few = kernel.fit_machine(gaussian, coded, 2, 1e-3, 5, label="two")
    monkeypatch.setattr(kernel, "MOST_SUMS", 1)
    many = kernel.fit_machine(gaussian, coded, 2, 1e-3, 5, label="two")
    assert np.allclose(few.weights, many.weights, rtol=1e-6) and np.abs(few.weights).max() > 0


def test_cosines_in_single_precision_however_far_a_row_lies(coded):
    gaussian = GaussianFeatures(coded, "features", 3)
    for x in (np.random.default_rng(1).normal(size=(50, 2)), np.array([[1e6, -3e5], [0.0, 1.0]])):
        exact = np.sqrt(2 / 256) * np.cos((x - gaussian.mean) * gaussian.scale @ gaussian.directions + gaussian.phases)
        assert np.abs(gaussian.piece()(x) - exact).max() < 1e-5


def test_weights_that_are_none_are_refused(coded):
    gaussian = GaussianFeatures(coded, "features", 3, components=16)
    for bad in (F.lit(None).cast("double"), F.lit(-1.0), F.lit(0.0)):
        with pytest.raises(Exception, match="weights"):
            kernel.fit_machine(gaussian, coded.withColumn("w", bad), 2, 1e-3, 2, label="two", weight="w")
