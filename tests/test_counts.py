"""Facts and leading values from keyed counts against plain counting."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.operators import counts, profile, quality
from auditloom.sources import tables

LONG = "a text that is longer than what stands in the key, "


@pytest.fixture(scope="module")
def mixed(spark):
    rows = []
    for i in range(400):
        text = [None, "", "short", LONG + str(i % 7), LONG + str(i), "  x"][i % 6]
        rows.append((i % 50 if i % 3 else None, float(i % 9) if i % 4 else float("nan"), text, i % 2 == 0, -(2**62) - i))
    return spark.createDataFrame(rows, "whole long, real double, text string, flag boolean, far long").repartition(3)


def plain(rows, c):
    return [v for v in (r[c] for r in rows) if v is not None and v == v]


def test_facts_equal_pandas(mixed):
    rows = mixed.collect()
    got = {r["column"]: r for r in counts.column_facts(mixed, mixed.columns, moments=True).collect()}
    for c in mixed.columns:
        values, seen = plain(rows, c), Counter(plain(rows, c))
        r = got[c]
        assert (r["n_rows"], r["n_null"], r["n_unique"]) == (400, 400 - len(values), len(seen))
        assert r["n_single"] == sum(n == 1 for n in seen.values())
        if c in ("whole", "real"):
            x = pd.Series(values, dtype=float)
            assert [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([x.mean(), x.std(), x.min(), x.max()])
            n, z = len(x), (x - x.mean()) / x.std(ddof=0)
            assert [r["g1"], r["g2"]] == pytest.approx([(z**3).mean(), (z**4).mean() - 3]) and r["n_zeros"] == (x == 0).sum() and n
        elif c == "far":
            assert r["min"] == pytest.approx(-(2.0**62) - 399)
        else:
            assert r["mean"] is None and r["n_zeros"] is None


@pytest.mark.parametrize("k", [1, 3, 100])
@pytest.mark.parametrize("smallest", [False, True])
def test_leading_values_equal_a_sort_of_all(mixed, k, smallest):
    rows = mixed.collect()
    top, _ = counts.leading_values(mixed, mixed.columns, k, smallest=smallest)
    got = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["column"], []).append((r["value"], r["n"], round(r["pct"], 6)))
    for c in mixed.columns:
        seen = Counter(plain(rows, c))
        name = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        order = sorted(seen, key=(lambda v: v) if smallest else (lambda v: (-seen[v], name(v))))
        assert got[c] == [(name(v), seen[v], round(seen[v] / 4, 6)) for v in order[:k]], c


def test_no_long_text_is_a_key_of_the_shuffle(mixed):
    keyed = counts.keyed_counts(mixed, ["text", "whole"]).collect()
    assert max(len(r["text"] or "") for r in keyed) <= counts.LONG_TEXT
    assert sum(r["n"] for r in keyed) == 800
    assert len({r["digest"] for r in keyed if r["digest"]}) == len({r["text"] for r in mixed.collect() if r["text"] and len(r["text"]) > 48})


def test_one_scan_for_a_preview(mixed, spark):
    plan = profile.column_preview(mixed.select("whole", "real"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate stack") == 1


def test_empty_tables_and_no_columns(spark, mixed):
    none = mixed.limit(0)
    assert counts.leading_values(none, none.columns, 3)[0].collect() == []
    assert {r["n_unique"] for r in profile.column_preview(none).collect()} == {0}
    assert profile.top_text_values(mixed.select("whole"), 3).collect() == []
    assert profile.sample_values(mixed.select("text").where("text is null"), 3).collect() == []
    assert [r["n_observations"] for r in quality.table_profile(none).collect()] == [0]


def test_csv_is_split_unless_texts_span_lines(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("id,text\n" + "".join(f'{i},"a, ""b"" {i}"\n' for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        split, whole = tables.read_table(spark, path), tables.read_table(spark, path, multi_line=True)
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert split.agg(F.sum("id")).first() == whole.agg(F.sum("id")).first() and split.first()["text"] == 'a, "b" 0'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with open(path, "w") as f:
        f.write('id,text\n1,"two\nlines"\n2,one\n')
    assert tables.read_table(spark, path, multi_line=True).count() == 2


def test_many_numbers_far_from_zero_keep_their_spread(spark):
    x = 1e9 + np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    r = counts.column_facts(df, ["x"], moments=True).first()
    assert r["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
