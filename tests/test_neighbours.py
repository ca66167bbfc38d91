"""The neighbour index against all pairs: the same rows, with fewer pairs compared."""

import numpy as np
import pytest

from auditloom.operators import neighbors as nb


def frame(spark, x, groups=None):
    rows = [(i, v.tolist(), int(groups[i]) if groups is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, g int").repartition(4)


def brute(x, k, groups=None):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        d[i] = np.inf
        if groups is not None:
            d[groups != groups[i]] = np.inf
        order = np.lexsort((np.arange(len(x)), d))[:k]
        out[i] = [j for j in order.tolist() if np.isfinite(d[j])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def clustered(n, rng, centres=30, dims=16):
    middle = rng.normal(size=(centres, dims)) * 6
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))


def shapes(rng):
    return {
        "clustered": (clustered(1200, rng), 0.35),
        "decaying": (rng.normal(size=(1000, 48)) * 0.8 ** np.arange(48), 0.4),
        "path": (np.cumsum(rng.normal(size=(1000, 6)), axis=0), 0.4),
        "copies": (np.repeat(rng.normal(size=(30, 5)), 20, axis=0), 1.0),
        "one_value": (np.ones((300, 4)), 1.0),
        "half_hot": (np.concatenate([np.zeros((300, 8)), clustered(300, rng, dims=8)]), 1.0),
        "plain": (rng.normal(size=(500, 24)), 1.0),
    }


@pytest.mark.parametrize("name", ["clustered", "decaying", "path", "copies", "one_value", "half_hot", "plain"])
def test_same_rows_as_all_pairs_and_fewer_compared(spark, name):
    x, share = shapes(np.random.default_rng(5))[name]
    work = spark.sparkContext.accumulator(0)
    assert found(nb.nearest_neighbours(frame(spark, x), "id", "v", 5, block_rows=48, work=work)) == brute(x, 5)
    assert 0 < work.value <= share * len(x) ** 2


@pytest.fixture(scope="module")
def given(spark):
    pdf = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").toPandas()
    return np.stack(pdf["embedding"]).astype(float)


def test_given_vectors_exact_and_hashed(spark, given):
    df, want = frame(spark, given), brute(given, 5)
    exact, hashed = (spark.sparkContext.accumulator(0) for _ in range(2))
    assert found(nb.nearest_neighbours(df, "id", "v", 5, block_rows=48, work=exact)) == want
    got = found(nb.nearest_neighbours(df, "id", "v", 5, method="lsh", near=0.3, recall=0.91, work=hashed))
    recall = sum(len({*got.get(i, [])} & {*w}) for i, w in want.items()) / (5 * len(want))
    assert recall >= 0.9
    assert exact.value < 0.9 * len(given) ** 2 and hashed.value < len(given) ** 2


def test_few_distances_are_computed_in_full_without_structure(spark):
    """Small blocks give loose bounds, which shrink with what is found, and no pair is given on that is not needed."""
    x = np.random.default_rng(6).normal(size=(2500, 64))
    work = spark.sparkContext.accumulator(0)
    assert found(nb.nearest_neighbours(frame(spark, x), "id", "v", 7, block_rows=64, work=work)) == brute(x, 7)
    assert work.value < 0.15 * len(x) ** 2


def test_hashing_of_clustered_vectors_compares_a_part(spark):
    x = clustered(1000, np.random.default_rng(2))
    work = spark.sparkContext.accumulator(0)
    got, want = found(nb.nearest_neighbours(frame(spark, x), "id", "v", 5, method="lsh", work=work)), brute(x, 5)
    assert sum(len({*got.get(i, [])} & {*w}) for i, w in want.items()) >= 0.9 * 5 * len(x)
    assert work.value < 0.5 * len(x) ** 2


def test_classes_of_unequal_size(spark):
    rng = np.random.default_rng(8)
    x, groups = clustered(500, rng, dims=6), np.where(rng.random(500) < 0.9, 0, rng.integers(1, 20, 500))
    df = frame(spark, x, groups)
    assert found(nb.nearest_neighbours(df, "id", "v", 4, within="g", block_rows=50)) == {i: w for i, w in brute(x, 4, groups).items() if w}


def test_few_rows_near_each_row_are_still_found(spark):
    """Blocks with k rows or fewer give no bound, so all others are asked."""
    x = np.concatenate([clustered(400, np.random.default_rng(3), dims=3), [[500.0, 0, 0], [0, 900.0, 0]]])
    assert found(nb.nearest_neighbours(frame(spark, x), "id", "v", 6, block_rows=20)) == brute(x, 6)


def test_bounds_are_never_too_high():
    rng = np.random.default_rng(4)
    x = clustered(600, rng, dims=5)
    index = nb._Index(x[:300], 12)
    cell, ring = index.place(x)
    for own in range(12):
        mine = x[cell == own]
        if not len(mine):
            continue
        least = index.least(mine, own, cell, ring)
        true = np.sqrt(((mine[:, None] - x[None]) ** 2).sum(2))
        assert (least <= true).all()


def test_tables_grow_with_the_sides_and_the_recall():
    assert nb.tables_for(0.8, 0.9, 4, 1) < nb.tables_for(0.8, 0.9, 12, 1) < nb.tables_for(0.8, 0.99, 12, 1)
    assert nb.tables_for(0.8, 0.9, 12, 3) < nb.tables_for(0.8, 0.9, 12, 0)
    assert nb.tables_for(1.0, 0.9, 12, 0) == 1


def test_hashing_into_many_tables_compares_a_pair_once(spark):
    """More buckets than tiles: vectors are sent to the tiles, whose rows meet once however many tables they share."""
    x = np.random.default_rng(9).normal(size=(600, 16))
    work = spark.sparkContext.accumulator(0)
    got, want = found(nb.nearest_neighbours(frame(spark, x), "id", "v", 5, method="lsh", bits=5, tables=60, work=work)), brute(x, 5)
    assert sum(len({*got.get(i, [])} & {*w}) for i, w in want.items()) >= 0.9 * 5 * len(x)
    assert 0 < work.value <= len(x) ** 2


@pytest.mark.parametrize("coarse", [3, 16])
def test_tiles_and_buckets_find_the_same(spark, coarse, monkeypatch):
    monkeypatch.setattr(nb, "COARSE_BITS", coarse)
    rng = np.random.default_rng(10)
    x, groups = clustered(600, rng, dims=6), np.where(rng.random(600) < 0.8, 0, rng.integers(1, 9, 600))
    df = frame(spark, x, groups)
    df = df.unionAll(df.where("id % 50 = 0"))  # ids that come twice
    points, few = nb._points(df, "id", "v", "g"), np.random.default_rng(11).normal(size=(6, 4 * 5))
    kept = [
        sorted(map(tuple, f(points, "bigint", 600, False, 32, few, 5, 2, None).distinct().collect()))
        for f in (nb._hashed_tiles, nb._hashed_buckets)
    ]
    assert kept[0] == kept[1] and 600 < len(kept[0]) < 600 * 599


@pytest.mark.parametrize("case", ["copies", "few_share", "classes", "ids_twice"])
def test_candidates_and_buckets_find_the_same(spark, case, monkeypatch):
    """The nearest rows that share a bucket, found by products first; rows that find too few go to the buckets."""
    rng = np.random.default_rng(12)
    groups = np.zeros(500, int)
    x = {"copies": np.repeat(rng.normal(size=(25, 6)), 20, axis=0), "few_share": -np.abs(rng.normal(size=(500, 6))) * rng.choice([-1, 1], 500)[:, None]}.get(case, clustered(500, rng, dims=6))
    if case == "classes":
        groups = np.where(rng.random(500) < 0.8, 0, rng.integers(1, 40, 500))
    df = frame(spark, x, groups)
    if case == "ids_twice":
        df = df.unionAll(df.where("id % 3 = 0")).unionAll(df.where("id % 7 = 0").selectExpr("id", "transform(v, y -> y + 0.5) as v", "g"))
    points, n_tables, bits = nb._points(df, "id", "v", "g"), {"few_share": 1}.get(case, 4), 6
    planes = np.random.default_rng(13).normal(size=(6, n_tables * bits))
    searched = []
    monkeypatch.setattr(nb, "_bucket_search", lambda *a, f=nb._bucket_search: searched.append(1) or f(*a))
    monkeypatch.setattr(nb, "CANDIDATES", 2)

    def nearest(f):
        pairs = f(points, "bigint", 3, False, 64, planes, bits, 1, None).groupBy("__id", "neighbour").agg({"distance": "min"}).collect()
        rows = sorted((i, round(d, 9), j) for i, j, d in map(tuple, pairs))
        return [r for k, r in enumerate(rows) if k < 3 or rows[k - 3][0] != r[0]]

    tried = nearest(nb._hashed_candidates)
    if case == "few_share":
        assert searched  # some rows were not done with their candidates
    assert tried == nearest(nb._hashed_tiles) and len(tried) > 200


def test_where_buckets_hold_many_rows_no_tile_is_hashed_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(nb, "_sharing", lambda *_: pytest.fail("a tile is hashed into all tables"))
    x = np.random.default_rng(14).normal(size=(800, 16))
    work = spark.sparkContext.accumulator(0)
    got = found(nb.nearest_neighbours(frame(spark, x), "id", "v", 5, method="lsh", near=0.3, recall=0.91, work=work))
    want = brute(x, 5)
    assert sum(len({*got.get(i, [])} & {*w}) for i, w in want.items()) >= 0.9 * 5 * len(x)
    assert work.value < 0.5 * len(x) ** 2


def test_pairs_within_a_limit_are_all_found():
    rng = np.random.default_rng(15)
    q, b = rng.normal(size=(70, 5)) * 1e3, rng.normal(size=(90, 5)) * 1e3
    b[:7], limits = q[:7], rng.random(70) * 2e3
    q[9, 2] = b[11, 0] = np.nan
    limits[3] = 0.0
    rows, cols = nb._Product(q, b).pairs(np.arange(70), np.arange(90), limits)
    true = {*zip(*map(np.ndarray.tolist, np.nonzero(np.sqrt(((q[:, None] - b[None]) ** 2).sum(2)) <= limits[:, None])))}
    got = {*zip(rows.tolist(), cols.tolist())}
    assert true <= got and (3, 3) in got and len(got) < 1.05 * len(true) + 5
