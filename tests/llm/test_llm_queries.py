"""The numbered queries against independent SQL, and the pipeline against its parts."""

import os

import duckdb
import pytest

import corpus_pipeline
from auditloom.llm import decontaminate, neardup, pii
from auditloom.llm.oracles import ORACLES
from auditloom.llm.queries import PII_KEY, QUERIES, table

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()]
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_a_row_for_every_document(spark, name):
    docs = {r[0] for r in table(spark, SF_DIR, "documents").select("doc_id").collect()}
    got = [r["doc_id"] for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect()]
    assert set(got) == docs and (name == "op2_packing" or len(got) == len(docs))


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF_DIR, "documents")
    benchmark = table(spark, SF_DIR, "benchmark")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, SF_DIR)
        assert seen.schema == docs.schema, name
        rows, old = {r["doc_id"]: r["text"] for r in seen.collect()}, {r["doc_id"]: r["text"] for r in before.collect()}
        assert set(rows) <= set(old)
        if name in ("quality classifier", "near-duplicates"):
            assert all(old[k] == t for k, t in rows.items())
        if name == "near-duplicates":
            found = neardup.near_duplicates(before).collect()
            assert set(rows) == {r["component_id"] for r in found}
        if name == "benchmark decontamination":
            hit = {r["doc_id"] for r in decontaminate.leaks(before, benchmark).filter("n_hit > 0").collect()}
            assert not decontaminate.leaks(seen, benchmark).filter("n_hit > 0").count()
            assert {k for k in old if rows.get(k) != old[k]} == hit
        if name == "personal data":
            assert set(rows) == set(old)
            assert rows == {k: pii.replaced(t, pii.pseudonyms(t, pii._key(PII_KEY))) for k, t in old.items()}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == set(rows)
