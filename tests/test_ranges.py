"""Ranks by ranges and blocks: what travels is a row per block, column and range, however these are cut."""

import numpy as np
import pandas as pd
import pytest

from auditloom.functions import ranges
from auditloom.operators import association, stats
from auditloom.session import settled
from tests.test_order_statistics import brute


@pytest.fixture
def kept(monkeypatch):
    """The frames that the operators write, as they are read back."""
    out = []
    for module in (association, stats):
        monkeypatch.setattr(module, "settled", lambda df: out.append(settled(df)) or out[-1], raising=False)
    return out


def table(spark, n=3000):
    rng = np.random.default_rng(12)
    x = rng.normal(size=n)
    pdf = pd.DataFrame({
        "x": x, "y": x + rng.normal(size=n), "often": np.where(rng.random(n) < 0.9, 2.0, rng.integers(0, 5, n)), "zeros": np.where(rng.random(n) < 0.5, -0.0, np.where(x > 0, 0.0, 1.0)),
        "holed": np.where(rng.random(n) < 0.4, np.nan, -x), "none": np.nan,
    })
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_a_row_per_block_column_and_range(spark, kept):
    pdf, df = table(spark)
    association.spearman(df, parts=4).collect()
    stats.shapiro_francia(df, 1000).collect()
    assert len(kept) == 2
    for dealt, most in zip(kept, (3 * 6 * 4, 3 * 6 * 3), strict=True):
        assert 0 < dealt.count() <= most
        n = dealt.groupBy("column").agg({"n": "count"}).count()
        assert n == 5  # the column without values has no row


@pytest.mark.parametrize(("block", "run"), [(1 << 18, 1 << 18), (64, 20)])
def test_blocks_and_runs_of_any_size(spark, block, run, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", block)
    monkeypatch.setattr(stats, "RUN", run)
    pdf, df = table(spark, 900)
    got = {(r[0], r[1]): r[2] for r in association.spearman(df, parts=3).collect()}
    assert len(got) == 15
    for (a, b), v in got.items():
        both = pdf[[a, b]].dropna().rank()
        want = np.corrcoef(both[a], both[b])[0, 1] if len(both) else np.nan
        assert v is None if np.isnan(want) else v == pytest.approx(want, abs=1e-9)
    found = {r["column"]: r for r in stats.shapiro_francia(df, 250).collect()}
    assert set(found) == {"x", "y", "often", "zeros", "holed"}
    for c, r in found.items():
        w, _ = brute(pdf[c].dropna())
        assert r["n"] == pdf[c].notna().sum() and abs(r["w"] - w) < 1e-7


def test_no_rows_and_no_columns(spark):
    _, df = table(spark, 20)
    assert {r["value"] for r in association.spearman(df.limit(0)).collect()} <= {None}
    assert stats.shapiro_francia(df.limit(0)).count() == 0
    assert stats.shapiro_francia(df.select()).count() == 0
