"""Threshold-scaled sketches against sets of all shingles, and neighbours by id against lists."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import fingerprints as fp
from auditloom.llm.ordered import in_ranges


def kept(text: bytes, width: int, scale: int) -> set[int]:
    """By one shingle at a time."""
    shingles = {text[i : i + width] for i in range(len(text) - width + 1)} or ({text} if text else set())
    values = {int(fp._hashes(np.frombuffer(s, np.uint8), len(s))[0]) for s in shingles}
    return {v for v in values if v < (1 << 48) // scale} or ({min(values)} if values else set())


def read(print_: str) -> set[int]:
    raw = base64.b64decode(print_)
    return {int.from_bytes(raw[i : i + 6], "big") for i in range(0, len(raw), 6)}


@pytest.fixture
def texts(rng):
    made = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    return [*made, "", "a", "short", "x" * 5000, made[3], "word " * 900 + made[5]]


@pytest.mark.parametrize(("width", "scale"), [(16, 32), (3, 2), (8, 4), (1, 1)])
def test_every_low_hash_is_kept_and_no_other(texts, width, scale):
    raw = [t.encode() for t in texts]
    got = fp.sketches(raw, width, scale)
    assert [set(s.tolist()) for s in got] == [kept(t, width, scale) for t in raw]
    assert all((np.diff(s.astype(np.int64)) > 0).all() for s in got)
    assert [read(fp.written(s)) for s in got] == [set(s.tolist()) for s in got]


def test_neighbours_equal_a_plain_loop(spark, docs_of, texts):
    docs = {7 * k - 100: t for k, t in enumerate(texts)} | {3000: None, 3001: "A text of its own. " * 40_000}
    got = {r["doc_id"]: r for r in fp.with_neighbours(docs_of(docs), part_bytes=2000).collect()}
    order = sorted(docs)
    assert sorted(got) == order
    for own, after in zip(order, [*order[1:], order[0]], strict=True):
        a, b = docs[own] or "", docs[after] or ""
        cut = len(a) // 4
        text = a[: len(a) - cut] + b[:cut]
        sets = [kept(t.encode(), fp.WIDTH, fp.SCALE) if len(t) < 10_000 else read(fp.written(fp.sketches([t.encode()])[0])) for t in (a, text, b)]
        row = got[own]
        assert row["n_chars"] == len(a) and row["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (read(row["fingerprint"]), read(row["edited_fingerprint"])) == (sets[0], sets[1])
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            either = sets[0] | other
            assert row[name] == pytest.approx(len(sets[0] & other) / len(either) if either else 1.0)


def test_estimates_are_close_on_unequal_documents(rng):
    base = "".join(rng.choice("abcdefgh ") for _ in range(400_000)).encode()
    part, (whole, inner) = base[1000:21_000], fp.sketches([base, base[1000:21_000]])
    mixed = part[:10_000] + bytes(rng.choice(b"xyz") for _ in range(10_000))
    assert set(inner.tolist()) <= set(whole.tolist())
    (half,) = fp.sketches([mixed])
    assert abs(len(np.intersect1d(half, whole)) / len(half) - 0.5) < 0.08
    assert abs(len(whole) / (400_000 / fp.SCALE) - 1) < 0.05


def test_columns_and_pooled_sketches(spark, docs_of, texts):
    prints = fp.fingerprints(docs_of(texts)).withColumn("g", F.col("doc_id") % 5)
    pooled = {}
    for r in fp.pooled(prints, ["g"]).collect():
        pooled.setdefault(r["g"], set()).update(read(r["hash"]))
    raw = {k: t.encode() for k, t in enumerate(texts)}
    for g in range(5):
        all_kept = set().union(*(kept(t, fp.WIDTH, fp.SCALE) for k, t in raw.items() if k % 5 == g))
        low = {v for v in all_kept if v < (1 << 48) // fp.SCALE}
        assert pooled[g] == (low or {min(all_kept)})
    pairs = prints.alias("a").join(prints.alias("b"), F.col("a.g") == F.col("b.g"))
    rows = pairs.select(
        F.col("a.fingerprint").alias("x"), F.col("b.fingerprint").alias("y"),
        fp.containment(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("c"),
        fp.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("j"),
    ).collect()
    for r in rows:
        x, y = read(r["x"]), read(r["y"])
        assert r["c"] == (len(x & y) / len(x) if x else None)
        assert r["j"] == (len(x & y) / len(x | y) if x | y else 1.0)


def test_edges(spark, edge_docs, no_docs):
    rows = fp.with_neighbours(edge_docs, part_bytes=200).collect()
    assert len(rows) == edge_docs.count()
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(same) == 1 and "" not in same
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {""}
    assert [r["near_next"] for r in rows if r["doc_id"] == 1] == [1.0]
    assert fp.with_neighbours(no_docs).collect() == []
    assert fp.fingerprints(no_docs).collect() == []
    one = fp.with_neighbours(edge_docs.filter("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_ranges_are_consecutive_and_closed(spark, rng):
    values = [(rng.choice([None, *range(50)]), rng.choice("ab")) for _ in range(3000)] + [(7, "a")] * 1500
    rows = spark.createDataFrame(values, "k int, s string")
    dealt, parts = in_ranges(rows, ["k", "s"], 9, closed=True)
    got = [tuple(r) for r in dealt.collect()]
    key = lambda r: ((r[0] is not None, r[0] or 0), r[1])
    own = sorted((r for r in got if not r[3]), key=lambda r: r[2])
    assert sorted(map(key, own)) == sorted(key((k, s)) for k, s in values)
    by_part = [[key(r) for r in own if r[2] == p] for p in range(parts)]
    assert parts > 3 and all(max(a) < min(b) for a, b in zip(by_part[:-1], by_part[1:], strict=True))
    for p in range(parts):
        copies = {key(r) for r in got if r[3] and r[2] == p}
        assert copies == {min(by_part[(p + 1) % parts])}
