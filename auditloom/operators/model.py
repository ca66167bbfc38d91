"""The proxy classifier: features, a repeatable split, training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import col, columns_of_kind, kind_of, number, value
from auditloom.functions.hashing import keyed_md5, unit_interval
from auditloom.functions.joins import join_lookup
from auditloom.functions.quantiles import exact_quantiles
from auditloom.functions.ranking import ordered_codes
from auditloom.operators.kernel import CALIBRATION_SHARE, COMPONENTS, GaussianFeatures, fit_machine, platt, probabilities
from auditloom.operators.resample import class_counts
from auditloom.operators.sampling import SEED, lowest_by_hash
from auditloom.session import settled

# The model names, their defaults, and the share of test rows.
TEST_SHARE = 0.25
FOREST, BOOSTING, LOGISTIC, SVM = "Random Forest", "Gradient Boosting", "Logistic Regression", "SVM"
#: Without a kernel; not among the fixed names.
LINEAR_SVM = "Linear SVM"
FOREST_TREES, FOREST_DEPTH = 100, 10
BOOSTING_TREES, BOOSTING_DEPTH = 100, 3
LOGISTIC_ITERATIONS, SVM_ITERATIONS = 1000, 100
# Fixed value: the deepest tree that Spark trains.
DEEPEST = 30


def encode_features(df: DataFrame, target: str, key: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Numbers for every feature column: text as alphabetical codes, numbers as they are.

    A null text counts as ``Missing``, a null number becomes the column's median. The
    encoded columns keep their names; ``target_code`` is the code of the target. Columns that
    are neither text nor number are left out. Each column of ``carry`` comes along as it
    was, as ``__carry_<i>``.
    """
    clean = df.where(value(df, target).isNotNull())
    features = columns_of_kind(df, "numeric", "categorical", exclude=[target, *key])
    text = [c for c in features if kind_of(df.schema[c].dataType) == "categorical"]
    numbers = [c for c in features if c not in text]

    filled = clean.select(
        *[col(c) for c in key],
        col(target).cast("string").alias(target),
        *[F.coalesce(col(c).cast("string"), F.lit("Missing")).alias(c) for c in text],
        *[number(clean, c).alias(c) for c in numbers],
        *[col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)],
    )
    if numbers:
        medians = exact_quantiles(filled, numbers, [0.5])
        filled = filled.withColumns({c: F.coalesce(col(c), F.lit(q[0])) for c, q in medians.items() if q})
    books = ordered_codes(filled, [*text, target])
    for c in [*text, target]:
        book, size = books[c]
        book = book.select(F.col("value").alias(c), F.col("code").cast("double").alias("__code"))
        filled = join_lookup(filled, book, [c], "left", n_rows=size)
        filled = filled.withColumnRenamed("__code", "target_code") if c == target else filled.withColumn(c, F.col("__code")).drop("__code")
    carried = [f"__carry_{i}" for i in range(len(carry))]
    return filled.select(*[col(c) for c in key], *[col(c) for c in features], col(target), "target_code", *carried)


def stratified_split(
    df: DataFrame, key: Sequence[str], target: str, test_share: float = TEST_SHARE, seed: int = SEED, exact: bool = False
) -> DataFrame:
    """Adds ``is_test``.

    By default a row is tested if its hash falls below the share: no shuffle, same rows
    on every run, and shares per class that are right on average. ``exact`` gives each
    class round(share x rows) test rows.
    """
    digest = keyed_md5(*[col(k) for k in key], str(seed))
    if not exact:
        return df.withColumn("is_test", unit_interval(digest) < test_share)
    quota = class_counts(df, target).select("label", F.round(F.col("n") * test_share).cast("bigint").alias("target_n"))
    chosen = lowest_by_hash(df.where(value(df, target).isNotNull()), target, key, quota, seed)
    marked = chosen.select(*[col(k).alias(f"__t_{i}") for i, k in enumerate(key)], F.lit(True).alias("__test"))
    same = [col(k) == F.col(f"__t_{i}") for i, k in enumerate(key)]
    return (
        df.join(marked, same, "left")
        .withColumn("is_test", F.coalesce("__test", F.lit(False)))
        .drop("__test", *[f"__t_{i}" for i in range(len(key))])
    )


def classifier(model_type: str, params: dict | None, n_rows: int, n_classes: int, weight: str | None, seed: int = SEED):
    """The Spark estimator for a model name; any unknown name means a random forest.

    ``params`` uses the names n_estimators, max_depth, learning_rate and C. The estimator of
    ``SVM`` is the linear one over the features of its kernel; ``fit_machine`` trains the same without holding these.
    """
    p = params or {}
    if p.get("max_depth", 0) > DEEPEST:
        raise ValueError(f"max_depth is {p['max_depth']}; trees can be {DEEPEST} deep at most")
    if model_type == LOGISTIC:
        model = LogisticRegression(
            maxIter=p.get("max_iter", LOGISTIC_ITERATIONS), regParam=1.0 / (p.get("C", 1.0) * max(n_rows, 1)), standardization=False
        )
    elif model_type == BOOSTING:
        model = GBTClassifier(
            maxIter=p.get("n_estimators", BOOSTING_TREES), maxDepth=p.get("max_depth", BOOSTING_DEPTH),
            stepSize=p.get("learning_rate", 0.1), seed=seed,
        )
    elif model_type in (SVM, LINEAR_SVM):
        model = LinearSVC(maxIter=p.get("max_iter", SVM_ITERATIONS), regParam=1.0 / (p.get("C", 1.0) * max(n_rows, 1)))
    else:
        model = RandomForestClassifier(
            numTrees=p.get("n_estimators", FOREST_TREES), maxDepth=p.get("max_depth", FOREST_DEPTH), seed=seed
        )
    if weight:
        model = model.setWeightCol(weight)
    if n_classes > 2 and model_type in (BOOSTING, SVM, LINEAR_SVM):
        return OneVsRest(classifier=model, weightCol=weight) if weight else OneVsRest(classifier=model)
    return model


def train_and_predict(
    df: DataFrame,
    key: Sequence[str],
    target: str,
    model_type: str = FOREST,
    params: dict | None = None,
    test_share: float = TEST_SHARE,
    weight: str | None = None,
    carry: Sequence[str] = (),
    exact_split: bool = False,
    seed: int = SEED,
    probability: bool = False,
) -> DataFrame:
    """(key, carried columns, y, yhat) for the test rows; labels as texts.

    Sensitive columns stay among the features, as a proxy model should see them. The
    encoded table is settled once, with the carried columns in it. ``SVM`` has a Gaussian
    kernel (``gamma``, by default one over the number of features, which are standardised;
    ``n_components`` random cosines). ``probability`` adds that of the predicted label; models
    without probabilities of their own are fitted on four fifths of the training rows and
    calibrated on the rest.
    """
    along = list(dict.fromkeys([*carry, *([weight] if weight else [])]))
    if model_type == SVM:  # encoding reads the input six times; a view's joins are made once
        used = dict.fromkeys([*key, target, *along, *columns_of_kind(df, "numeric", "categorical")])
        df = settled(df.select(*[col(c) for c in df.columns if c in used]))
    encoded = encode_features(df, target, key, along)
    skipped = {*key, target, "target_code", *([weight] if weight else []), *(f"__carry_{i}" for i in range(len(along)))}
    features = [c for c in encoded.columns if c not in skipped]
    points = stratified_split(encoded, key, target, test_share, seed, exact_split).select(
        *[col(k).alias(f"__key_{i}") for i, k in enumerate(key)],
        col(target).alias("__label"), "target_code", "is_test",
        array_to_vector(F.array(*[col(c) for c in features])).alias("features"),
        *[F.col(f"__carry_{i}") for i in range(len(along))],
    )
    points = settled(points)
    labels = points.groupBy("target_code").agg(F.first("__label").alias("yhat"))
    n_classes = labels.count()
    train = points.where(~F.col("is_test"))
    weight_col = f"__carry_{along.index(weight)}" if weight else None
    p = params or {}
    if model_type == SVM:
        kernel = GaussianFeatures(train, "features", seed, p.get("gamma"), p.get("n_components", COMPONENTS))
    calibrate = probability and (model_type in (SVM, LINEAR_SVM) or (model_type == BOOSTING and n_classes > 2))
    if calibrate:
        draw = unit_interval(keyed_md5(*[F.col(f"__key_{i}") for i in range(len(key))], f"calibration-{seed}"))
        train, held_out = train.where(draw >= CALIBRATION_SHARE), train.where(draw < CALIBRATION_SHARE)
    n_rows = train.count()
    if model_type == SVM:
        reg = 1.0 / (p.get("C", 1.0) * max(n_rows, 1))
        fitted = fit_machine(kernel, train, n_classes, reg, p.get("max_iter", SVM_ITERATIONS), "features", "target_code", weight_col)
    else:
        model = classifier(model_type, params, n_rows, n_classes, weight_col, seed)
        fitted = model.setFeaturesCol("features").setLabelCol("target_code").fit(train)

    scored = fitted.transform(points.where("is_test"))
    chances = []
    if probability:
        known = vector_to_array("probability") if not calibrate else probabilities(
            platt(fitted.transform(held_out), "target_code", n_classes, weight_col), n_classes
        )
        scored = scored.withColumn("__chance", F.get(known, F.col("prediction").cast("int")))
        chances = [F.col("__chance").alias("probability")]
    scored = scored.drop("target_code").withColumnRenamed("prediction", "target_code")
    return join_lookup(scored, labels, ["target_code"], "left", n_rows=n_classes).select(
        *[F.col(f"__key_{i}").alias(k) for i, k in enumerate(key)], F.col("__label").alias("y"), "yhat",
        *[F.col(f"__carry_{along.index(c)}").alias(c) for c in carry], *chances,
    )
