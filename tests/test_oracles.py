"""Every query against its independent SQL, on whole tables at the smallest scale."""

import os

import duckdb
import pytest

from checks.fixtures import TABLES
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def comparable(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = [tuple(comparable(r[names.index(c)]) for c in order) for r in cursor.fetchall()]
    actual = [tuple(comparable(r[c]) for c in order) for r in got]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_entry_returns_findings(spark):
    from __spark_entry__ import entry

    out = entry(spark)
    assert out.columns == ["stage", "operator", "subject", "metric", "value_double", "value_string"]
    assert out.count() > 100
