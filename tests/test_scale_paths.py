"""The paths taken by large tables, forced on small ones and compared with brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.functions.joins import join_lookup
from auditloom.functions.quantiles import exact_quantiles, narrowed_quantiles
from auditloom.functions.ranking import ordered_codes, running_totals
from auditloom.operators import association, profile, quality, resample
from auditloom.operators.neighbors import knn_consistency, nearest_neighbours
from auditloom.operators.sampling import draws, lowest_by_hash, numbered_rows

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def hot_numbers(spark, n=20_000):
    """One value holds a third of all rows; also nulls, a constant and a tiny column."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=n)
    x[rng.random(n) < 1 / 3] = 0.25
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "hot": x,
                "skewed": np.exp(rng.normal(size=n) * 3),
                "whole": rng.integers(0, 5, n).astype(float),
                "const": np.full(n, 3.0),
                "some": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)),
                "none": np.full(n, np.nan),
            }
        )
    )


def test_narrowed_quantiles_equal_numpy(spark):
    df = hot_numbers(spark).repartition(5)
    pdf = df.toPandas()
    # small limits force several rounds of narrowing
    got = narrowed_quantiles(df, df.columns, PROBS, interval_rows=5, accuracy=50)
    for c in df.columns:
        known = pdf[c].dropna()
        if known.empty:
            assert got[c] is None
        else:
            assert got[c] == pytest.approx(list(np.quantile(known, PROBS)), rel=1e-12, abs=1e-12)


def test_direct_and_narrowed_quantiles_agree(spark):
    df = hot_numbers(spark, 3000)
    direct = exact_quantiles(df, ["hot", "skewed", "some"], PROBS, direct_rows=10**9)
    narrowed = exact_quantiles(df, ["hot", "skewed", "some"], PROBS, direct_rows=0, interval_rows=10)
    for c in direct:
        assert direct[c] == pytest.approx(narrowed[c], rel=1e-12)


def test_outliers_and_medians_do_not_depend_on_the_path(spark, rows):
    df = hot_numbers(spark, 3000).drop("none")
    assert rows(quality.iqr_outliers(df, direct_rows=10**9)) == rows(quality.iqr_outliers(df, direct_rows=0))
    a, b = (rows(profile.numeric_stats(df, direct_rows=n)) for n in (10**9, 0))
    assert a == b


@pytest.mark.parametrize("limit", [10**6, 50, 3])
def test_running_totals(spark, limit):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 2000), "value": rng.permutation(2000), "n": rng.integers(1, 9, 2000)})
    pdf.loc[pdf.k == 2, "k"] = 0
    got = running_totals(spark.createDataFrame(pdf), ["k"], values_per_task=limit).toPandas()
    assert len(got) == 2000
    got = got.sort_values(["k", "value"])
    expected = got.groupby("k").n.cumsum() - got.n
    assert (got.before == expected).all()


def test_ordered_codes(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "c string")
    codes, size = ordered_codes(df, ["c"])["c"]
    assert rows(codes) == [("a", 0), ("b", 1), ("c", 2)] and size == 3


@pytest.mark.parametrize(("parts", "frequent"), [(1, 1), (7, 10_000), (3, 40)])
def test_spearman_equals_pandas(spark, parts, frequent, monkeypatch):
    """However values are cut into ranges, and whichever of them are broadcast."""
    monkeypatch.setattr(association, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    n = 1500
    x = rng.integers(0, 40, n).astype(float)
    pdf = pd.DataFrame({"x": x, "y": x + rng.normal(size=n) * 9, "z": np.where(rng.random(n) < 0.3, np.nan, -x), "w": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))})
    df = spark.createDataFrame(pdf)
    got = {(r["column_a"], r["column_b"]): r["value"] for r in association.spearman(df, parts=parts).collect()}
    for (a, b), v in got.items():
        both = pdf[[a, b]].dropna().rank()
        assert v == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-9)
    assert len(got) == 6


def test_spearman_of_constant_empty_and_single_columns(spark):
    rows = [(float(i), 1.0, None, float(i) if i < 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, same double, none double, few double")
    got = {(r[0], r[1]): r[2] for r in association.spearman(df).collect()}
    assert len(got) == 6 and got.pop(("a", "few")) == pytest.approx(1.0) and set(got.values()) == {None}
    assert association.spearman(df.select("a")).collect() == []
    assert {r["value"] for r in association.spearman(df.limit(0)).collect()} <= {None}


def test_the_plan_of_spearman_grows_with_columns_only(spark):
    df = spark.range(200).select(*[F.when(F.col("id") % (k + 2) > 0, F.col("id") * k % 17).alias(f"c{k}") for k in range(12)])
    plan = association.spearman(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 and plan.count("Range (0") == 0 + plan.count("Range (0, 200") <= 2


def test_pearson_of_awkward_columns(spark):
    rng = np.random.default_rng(11)
    n = 900
    x = rng.random(n)
    pdf = pd.DataFrame(
        {"x": x, "far": 1e9 + x, "const": np.full(n, 0.1), "some": np.where(rng.random(n) < 0.5, np.nan, x**2), "none": np.full(n, np.nan)}
    )
    # flat on the rows where `some` is known
    pdf["half"] = np.where(pdf.some.isna(), x, 0.3)
    got = {(r["column_a"], r["column_b"]): r["value"] for r in association.pearson(spark.createDataFrame(pdf).repartition(4)).collect()}
    assert got["x", "far"] == pytest.approx(1.0, abs=1e-6)
    assert got["x", "const"] is None and got["x", "none"] is None and got["some", "half"] is None
    both = pdf[["x", "some"]].dropna()
    assert got["x", "some"] == pytest.approx(np.corrcoef(both.x, both.some)[0, 1], abs=1e-10)


def brute_neighbours(ids, x, k, labels=None, include_self=False):
    out = {}
    for i, a in enumerate(ids):
        near = sorted(
            (float(np.sqrt(((x[i] - x[j]) ** 2).sum())), int(b))
            for j, b in enumerate(ids)
            if (include_self or i != j) and (labels is None or labels[i] == labels[j])
        )
        out[int(a)] = near[:k]
    return out


@pytest.mark.parametrize("block_rows", [4096, 40, 7])
def test_neighbours_are_exact_with_copies_and_dense_spots(spark, block_rows):
    rng = np.random.default_rng(1)
    n, k = 360, 4
    centres = rng.normal(size=(5, 6)) * 4
    x = (centres[rng.integers(0, 5, n)] + rng.normal(size=(n, 6))).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows are copies of one row
    labels = rng.integers(0, 2, n)
    ids = rng.permutation(n * 3)[:n]
    df = spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, labels)], "id bigint, v array<float>, y int").repartition(6)
    got = {}
    for r in nearest_neighbours(df, "id", "v", k, within="y", block_rows=block_rows).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    expected = brute_neighbours(ids, x.astype(float), k, labels)
    assert got.keys() == expected.keys()
    for i in expected:
        assert [j for _, j in got[i]] == [j for _, j in expected[i]]
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in expected[i]], abs=1e-9)


def test_neighbours_when_there_are_too_few(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1)], "id int, v array<double>, y int")
    got = {(r["id"], r["neighbour"], r["rank"]) for r in nearest_neighbours(df, "id", "v", 3, within="y").collect()}
    assert got == {(1, 2, 1), (2, 1, 1)}


def test_text_keys_work_for_neighbours(spark):
    df = spark.createDataFrame([(f"k{i}", [float(i)]) for i in range(30)], "id string, v array<double>")
    got = {r["id"]: r["neighbour"] for r in nearest_neighbours(df, "id", "v", 1, block_rows=6).collect()}
    assert got["k0"] == "k1" and got["k5"] == "k4" and len(got) == 30


def test_consistency_with_and_without_self(spark):
    df = spark.createDataFrame([(i, [float(i)], int(i < 5)) for i in range(10)], "id int, v array<double>, y int")
    near = brute_neighbours(range(10), np.arange(10.0)[:, None], 3, include_self=True)
    y = [int(i < 5) for i in range(10)]
    expected = 1 - np.mean([abs(y[i] - np.mean([y[j] for _, j in near[i]])) for i in range(10)])
    assert knn_consistency(df, "id", "v", "y", 3, block_rows=3).first()["consistency"] == pytest.approx(expected)
    assert knn_consistency(df, "id", "v", "y", 3, include_self=False).first()["consistency"] < expected


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lookups_broadcast_or_shuffle_with_one_result(spark, limit):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").select(F.when(F.col("k") > 0, F.col("k")).alias("k"), "id")
    small = spark.createDataFrame([(None, "null"), (1, "one"), (2, "two")], "k bigint, name string")
    plain = join_lookup(big, small, ["k"], "left", max_rows=limit)
    assert plain.count() == 1000 and plain.where("name is not null").count() == 286
    safe = join_lookup(big, small, ["k"], "left", null_safe=True, max_rows=limit)
    assert safe.where("name is not null").count() == 429


def test_a_hot_row_is_found_by_both_duplicate_paths(spark, rows, monkeypatch):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("a"), F.lit(None).cast("string").alias("b"))
    expected = [(900, 299, 33.222222)]
    assert rows(quality.duplicates(df)) == expected
    monkeypatch.setattr(quality, "BROADCAST_HASHES", 0)
    assert rows(quality.duplicates(df)) == expected


def labelled(spark, parts=4):
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 4, "mid").otherwise("big").alias("y")
    ).repartition(parts)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_quotas_are_exact_for_any_bucket_width(spark, digits):
    df = labelled(spark)
    quota = spark.createDataFrame([("big", 123), ("mid", 0), ("rare", 10**6)], "label string, target_n bigint")
    got = lowest_by_hash(df, "y", ["id"], quota, digits=digits)
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {"big": 123, "rare": 300}


def test_row_numbers_are_dense(spark):
    got = numbered_rows(labelled(spark), "y", ["id"], digits=1).groupBy("__label").agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.count_distinct("rn").alias("d")
    )
    for r in got.collect():
        assert (r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"])


def test_draws_are_complete_over_many_blocks(spark):
    plan = spark.createDataFrame([("a", 5, 28), ("b", 28, 28), ("c", 27, 28)], "label string, n bigint, target_n bigint")
    got = sorted((r["label"], r["draw"]) for r in draws(plan, per_task=4).collect())
    assert got == [("a", i) for i in range(23)] + [("c", 0)]


@pytest.mark.parametrize("make", ["oversample", "undersample"])
def test_resampling_does_not_depend_on_partitioning(spark, rows, make):
    def run(parts):
        return rows(getattr(resample, make)(labelled(spark, parts), ["id"], "y"))

    assert run(1) == run(4) == run(16)


def test_resampled_rows_come_from_the_table(spark):
    df = labelled(spark)
    over = resample.oversample(df, ["id"], "y")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {"big": 1800, "mid": 1800, "rare": 1800}
    assert over.where("draw is null").drop("draw").exceptAll(df).count() == 0
    assert over.drop("draw").join(df, ["id", "y"], "left_anti").count() == 0
    under = resample.undersample(df, ["id"], "y")
    assert {r["y"]: r["count"] for r in under.groupBy("y").count().collect()} == {"big": 300, "mid": 300, "rare": 300}
    assert under.count() == under.distinct().count()


def test_rows_without_target_stay(spark):
    df = labelled(spark).withColumn("y", F.when(F.col("id") % 100 != 1, F.col("y")))
    for made in (resample.oversample(df, ["id"], "y"), resample.undersample(df, ["id"], "y")):
        assert made.where("y is null").count() == 30


def test_narrowing_reads_the_rows_a_few_times(spark):
    """Values over many magnitudes, of which no range holds few rows at first."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=95_000) * 10.0 ** rng.integers(-30, 30, 95_000), np.zeros(5_000), [-0.0, np.inf, -np.inf]])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(4).mapInPandas(counted, "x double")
    got = narrowed_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], interval_rows=10)["x"]
    assert got == [pytest.approx(v, rel=1e-12) for v in np.quantile(x, [0.1, 0.25, 0.5, 0.9])]
    assert read.value <= 3 * len(x)
