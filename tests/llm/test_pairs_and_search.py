"""Near-duplicates, exact top-k and packing: against brute force, on hot groups and edge cases."""

import math
import zlib

import numpy as np
import pytest

from auditloom.llm import neardup, packing, topk
from auditloom.llm.queries import QUERIES, tokenizer
from auditloom.llm.shared import components
from pyspark.sql import functions as F


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51)], [(5, 5)], []])
def test_components_reach_however_far(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


# ------------------------------------------------------------------ near-duplicates


def brute_duplicates(docs, n=5, percent=80):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().translate(bytes(neardup_lower())).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def neardup_lower():
    from auditloom.llm.words import LOWER

    return LOWER.tolist()


@pytest.mark.parametrize("block", [512, 5])
def test_groups_equal_brute_force_whole_or_in_blocks(docs_of, rng, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    texts = []
    for base in range(12):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = [x if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else f"e{rng.randint(0, 99)}" for x in w]
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    texts += [None, "", "one", "One", "a b c", "a b c d"]
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs_of(texts)).collect())
    assert got == brute_duplicates(list(enumerate(texts)))


def test_chain_of_links_is_one_component(docs_of):
    """Neighbours share 0.8 or more, the ends share nothing."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[8 * k : 8 * k + 104]) for k in range(30)]
    assert {r["component_id"] for r in neardup.near_duplicates(docs_of(texts)).collect()} == {0}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    common, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (6000, 2000, 2000))
    both = [np.sort(np.concatenate([common, x])) for x in (one, two)]
    s = neardup.signature(np.concatenate(both), np.array([8000, 8000]), size=512)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.6) < 0.08


def test_near_duplicates_edge_cases(spark, edge_docs, no_docs):
    got = sorted((tuple(r) for r in neardup.near_duplicates(edge_docs).collect()), key=repr)
    by_id = {r[0]: r for r in got}
    assert len(got) == 10 and by_id[4][2:] == (4, True) and by_id[5][2:] == (4, False)
    assert by_id[1] == (1, 0, 1, True) and by_id[3] == (3, 0, 3, True) and by_id[None][2:] == (None, True)
    assert neardup.near_duplicates(no_docs).collect() == []


# ------------------------------------------------------------------ exact top-k


def brute_top(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "queries"), [(16_384, 2_048), (70, 5)])
def test_top_k_equals_brute_force(spark, rng, shard, queries):
    centres = [[rng.gauss(0, 0.2) for _ in range(24)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.06) for c in rng.choice(centres)]) for i in range(500)]
    rows += [(i, rows[0][1]) for i in range(500, 660)]  # a hot vector, more copies than k
    rows += [(660, None), (680, [1.0, None]), (700, [float("nan")]), (None, rows[1][1]), (720, []), (740, [0.5, -3.0]), (760, [1e7] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, shard=shard, queries=queries).collect())
    assert got == brute_top(rows)


def test_top_k_stops_early_on_proof():
    """On clustered vectors most queries end before the last segment, with the same result."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (20, 64))
    numbers = np.rint(np.repeat(centres, 200, 0) + rng.normal(0, 1, (4000, 64))).astype(np.int16)
    shard = topk.Shard(np.arange(4000), numbers)
    read = []
    shard.segments = [Spy(s, read, k) for k, s in enumerate(shard.segments)]
    found = list(shard.best(np.arange(0, 100), numbers[:100], 20))
    assert len(found) == 100 and max(read) < len(topk.SEGMENTS) - 1
    for i, ids, scores in found:
        exact = numbers.astype(int) @ numbers[i].astype(int)
        exact[i] = -(1 << 60)
        order = np.lexsort((np.arange(4000), -exact))[:20]
        assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()


class Spy:
    """A segment that notes when it is read."""

    def __init__(self, matrix, read, k):
        self.matrix, self.read, self.k = matrix, read, k

    def __getitem__(self, part):
        self.read.append(self.k)
        return self.matrix[part]


def test_top_k_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, score string, id string, shard string")
    assert topk.top_k(empty, F.col("id") % 20 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0], "x"), (0, [2.0], "x"), (1, [0.5], "x"), (1, [0.5], "x")], "vec_id long, embedding array<float>, id string")
    got = sorted(tuple(r) for r in topk.top_k(few, F.col("id") % 20 == 0).collect())
    assert len(got) == 4 and {r[2] for r in got} == {1}  # rows of the query's own id are no candidates


@pytest.mark.parametrize(("shard", "queries"), [(16_384, 2_048), (9, 2)])
def test_rows_that_share_a_query_id_get_a_list_each(spark, rng, shard, queries):
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 60)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (0, [0.0, -1.0, 0.0, 0.0]), (0, [0.0, -1.0, 0.0, 0.0]), (40, [0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, shard=shard, queries=queries).collect())
    assert got == brute_top(rows) and sum(r[0] == 0 for r in got) == 60


# ------------------------------------------------------------------ packing


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


TRICKY = [
    "", " ", "a", "  a  b ", " lead", "tab\t x", "nl \n x", "don't <|endoftext|> it's", "“q” – z ’ s", "　 z a   b", "é à ç", "漢 字 の テ",
    "a\x1c b", "1 22 333 a1 b2", "x" * 3000, "a\u0085 b", "\U0001f600 \U0001f601 q",
]


@pytest.mark.parametrize("quick", [True, False])
def test_ids_are_the_tokenizers(plain, rng, quick):
    table = packing.Tokens(tokenizer())
    assert table.quick is not None
    table.quick = table.quick if quick else None
    bits = [*"aé \n\t.'’ 1漢", "  ", " the", "'s", "　", " "]
    texts = TRICKY + ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(800)]
    for _ in range(2):  # the second time all parts are known
        ids, counts = table.of([t.encode() for t in texts])
        ends = np.cumsum(counts)
        for t, n, e in zip(texts, counts, ends, strict=True):
            assert ids[e - n : e].tolist() == plain(t)[:-1], repr(t)


@pytest.mark.parametrize("quick", [True, False])
def test_marked_ids_are_those_of_the_unmodified_tokenizer(spark, tmp_path, rng, quick):
    from tokenizers import Tokenizer

    unmodified = Tokenizer.from_file(tokenizer())
    table = packing.Tokens(tokenizer(), marked=True)
    table.quick = table.quick if quick else None
    mark = "<|endoftext|>"
    bits = [*"aé \n.'1漢", "  ", " the", mark, "<|", "|>"]
    texts = [*TRICKY, mark, mark * 2, f" {mark} ", f"a {mark}b", f"x\n{mark}\n y"]
    texts += ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(500)]
    for _ in range(2):
        ids, counts = table.of([t.encode() for t in texts])
        for t, n, e in zip(texts, counts, np.cumsum(counts), strict=True):
            assert ids[e - n : e].tolist() == unmodified.encode(t, add_special_tokens=False).ids, repr(t)
    if quick:
        spark.createDataFrame([(k, t) for k, t in enumerate(texts[:25])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in QUERIES["op2_packing"](spark, str(tmp_path)).filter("piece = 0").collect()}
        for k, t in enumerate(texts[:25]):
            own = [*unmodified.encode(t, add_special_tokens=False).ids, 0]
            if len(own) <= packing.CAPACITY:
                assert got[k] == (len(own), zlib.crc32(np.array(own, "<u4").tobytes())), repr(t)


def check_packing(found, capacity):
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize(("capacity", "shard"), [(2048, 50_000), (64, 50)])
def test_pieces_cover_documents_and_sequences_are_gapless(docs_of, rng, plain, capacity, shard):
    texts = [" ".join(rng.choices(["the", "quick", "brown", "éa", "x1"], k=rng.randint(0, 150))) for _ in range(300)] + [None, "", *TRICKY]
    rows = packing.packed(docs_of(texts), tokenizer(), capacity=capacity, shard_pieces=shard, with_ids=True).collect()
    n = check_packing(rows, capacity)
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = by_doc.setdefault(r["doc_id"], [])
        assert r["start"] == len(ids) and r["length"] == len(r["ids"]) and (r["piece"] == 0 or r["length"] == capacity)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        ids += r["ids"]
    assert by_doc == {k: plain(t) for k, t in enumerate(texts)}
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert n <= least * 1.05 + 1


def test_sum_of_squares_rule_by_hand():
    # 6 opens a sequence (gap 4); 4 fills it: squares fall; 5 opens one, 5 fills it; 3 opens one
    sequence, offset = packing.sum_of_squares(np.array([6, 4, 5, 5, 3]), 10)
    assert sequence.tolist() == [0, 0, 1, 1, 2] and offset.tolist() == [0, 6, 0, 5, 0]


def test_each_placement_makes_the_squares_smallest(rng):
    capacity, gaps = 12, {}
    lengths = [rng.randint(1, capacity) for _ in range(400)]
    sequence, offset = packing.sum_of_squares(np.array(lengths), capacity)
    squares = lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
    for size, s, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
        options = {squares([*gaps.values(), capacity - size])}
        options |= {squares([g - size if k == t else g for k, g in gaps.items()]) for t in gaps if gaps[t] >= size}
        gaps[s] = gaps.get(s, capacity) - size
        assert o == capacity - gaps[s] - size and squares(list(gaps.values())) == min(options)


def test_packing_edge_cases(edge_docs, no_docs):
    rows = packing.packed(edge_docs, tokenizer()).collect()
    check_packing(rows, packing.CAPACITY)
    assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] is not None}) < len(rows)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.packed(no_docs, tokenizer()).collect() == []


def test_sequences_join_ids_in_order(docs_of, plain):
    packed = packing.packed(docs_of(["one two", "three", None]), tokenizer(), with_ids=True)
    (only,) = packing.sequences(packed).collect()
    order = sorted(packed.collect(), key=lambda r: r["offset"])
    assert only["ids"] == [i for r in order for i in r["ids"]] and sorted(only["ids"]) == sorted(plain("one two") + plain("three") + [0])
