"""Shapiro-Francia over distributed ranks, against one sorted array."""

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from auditloom.functions.numbers import normal_quantile, normal_upper_tail
from auditloom.operators.stats import shapiro_francia


def brute(x):
    x = np.sort(np.array(x, float))
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (len(x) + 0.25)) for i in range(1, len(x) + 1)])
    w = ((x - x.mean()) @ m) ** 2 / (((x - x.mean()) ** 2).sum() * (m @ m))
    log_n = math.log(len(x))
    z = (math.log(1 - w) + 1.2725 - 1.0521 * (math.log(log_n) - log_n)) / (1.0308 - 0.26758 * (math.log(log_n) + 2 / log_n))
    return w, 1 - NormalDist().cdf(z)


def test_quantiles_and_tails(spark):
    ps = [1e-12, 0.001, 0.0242, 0.0243, 0.3, 0.5, 0.77, 0.9757, 0.9758, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("q")).collect()
    assert all(abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-7 for r in got)
    zs = [-6.0, -1.5, 0.0, 0.2, 1.6449, 5.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_upper_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(-r["z"])) < 1e-7 for r in got)


def test_columns_of_many_shapes(spark):
    rng = np.random.default_rng(3)
    n = 9000
    shapes = {
        "normal": rng.normal(5, 2, n), "skewed": rng.exponential(1, n), "ties": np.where(rng.random(n) < 0.6, 1.0, rng.integers(0, 9, n)),
        "far": 1e9 + rng.normal(0, 1e-2, n), "flat": np.full(n, 3.0), "infinite": np.r_[np.inf, rng.normal(size=n - 1)],
    }
    rows = [tuple(float(shapes[c][i]) for c in shapes) + (None if i % 3 else float(shapes["normal"][i]), float(i) if i < 4 else None) for i in range(n)]
    names = [*shapes, "holed", "few"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(6)
    for values_per_task in (500_000, 700):
        got = {r["column"]: r for r in shapiro_francia(df, values_per_task).collect()}
        assert set(got) == {"normal", "skewed", "ties", "far", "holed"}
        for c, r in got.items():
            x = [v for v in (row[names.index(c)] for row in rows) if v is not None]
            w, p = brute(x)
            assert r["n"] == len(x) and abs(r["w"] - w) < 1e-7 and abs(r["p_value"] - p) < 1e-4, (c, r, w, p)
        assert got["normal"]["is_normal"] and not got["skewed"]["is_normal"] and not got["ties"]["is_normal"]
    assert shapiro_francia(df.limit(0)).count() == 0
