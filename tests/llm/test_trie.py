"""The prefix tree against a tree built turn by turn in one process."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from auditloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv string, single string"


def ordered(rows):
    """Turns of each conversation as (role, text), in the documented order."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t for *_, t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def below(path):
        todo = [path]
        while todo:
            at = todo.pop()
            yield at
            todo += kids.get(at, [])

    out = []
    for path, cs in members.items():
        tree = list(below(path))
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids.get(path, [])),
            sum(not kids.get(p) for p in tree), sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in tree if p),
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def made(rng, n, longest=12):
    texts = ["hello", "", None, "where é is 漢", "tell me more", "no", "yes", "a longer text of several words"]
    rows = []
    for c in rng.sample(range(-40, 3 * n), n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, rng.choice([turn, turn, None, 3]), role, rng.choice(texts[: 1 + turn % 4] if rng.random() < 0.9 else texts), "x", "y", "z"))
    return [*rows, *rng.sample(rows, len(rows) // 10)]


def families(df, **kw):
    return trie.tree_of_families(df, F.crc32(F.col("conv").cast("string")) % 9, longest=8, family=5, **kw)


@pytest.mark.parametrize("most", [1, 64, trie.MOST_CELLS])
def test_equals_a_tree_built_in_one_process(spark, rng, monkeypatch, most):
    """Whatever the sketch can tell apart."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "_CHUNK", 2)
    rows = made(rng, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = ordered(rows)
    assert got(families(df, most=most)) == brute(rebuilt(want))
    if most == 64:
        assert got(trie.tree(df, most)) == brute(want)


def test_the_sketch_never_estimates_too_low_and_screens_tails(spark, rng):
    rows = made(rng, 200)
    given = trie.turns(spark.createDataFrame(rows, SCHEMA))
    found = trie.prefixes(given, given.select("conv").distinct()).persist()
    for most in (1 << 7, trie.MOST_CELLS):
        marked = trie.screened(found, most)
        true = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
        wrong = marked.join(true, ["d1", "d2"]).filter("single AND n > 1")
        assert wrong.count() == 0
    lone = true.filter("n = 1").count()
    assert marked.filter("single").count() > 0.9 * lone > 0


def test_one_long_conversation_and_its_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    long = [(c, t, "user", f"turn {t}") for c in (5, 7) for t in range(700)] + [(7, 700, "user", "more")]
    rows = long + [(6, 0, "user", "turn 0"), (11, None, "user", "alone"), (None, 1, "user", "nobody's")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    want = ordered(rows)
    assert {c: len(t) for c, t in want.items()} == {5: 700, 7: 701, 6: 1, 11: 1}
    small = {c: t for c, t in want.items()}
    result = got(trie.tree(df))
    nodes = {(r[0], r[1]): r for r in result}
    assert len(result) == 1 + 700 + 1 + 1 and nodes[(5, 0)][3:6] == (4, 2, 2)
    saved = sum(len(f"turn {t}") for t in range(700)) + len("turn 0")
    assert nodes[(5, 1)][6] == saved and nodes[(7, 701)][2] == 5
    assert sorted(brute({c: t[:40] for c, t in small.items()}), key=repr)[0][1] in range(41)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert families(none).collect() == [] and trie.tree(none).collect() == []
    only_null = spark.createDataFrame([(None, 1, "user", "x", "", "", "")], SCHEMA)
    assert families(only_null).collect() == []
    one = spark.createDataFrame([(3, None, None, None, "", "", "")], SCHEMA)
    assert got(trie.tree(one)) == brute({3: [("", "")]})
    assert got(families(one)) == brute(rebuilt({3: [("", "")]}))
    text = "é" * 600_000
    two = [(c, 1, "user", text, "", "", "") for c in (1, 2, 8)]
    assert got(trie.tree(spark.createDataFrame(two, SCHEMA))) == brute({c: [("user", text)] for c in (1, 2, 8)})
