"""Links and groups of two tokenizers against one loop over all token pairs with unmodified encoders."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from auditloom.llm import alignment as al

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(encoders, text):
    """Ids and byte spans of both, the links, and the groups as text."""
    a, b = encoders
    plain = {chr(k): k for k in al.PLAIN_BYTES}
    names = plain | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain.values())}
    empty = {"n": (0, 0, 0), "links": [], "groups": ""}
    if not text:
        return empty
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_bytes = [bytes(names[c] for c in a.id_to_token(k)) for k in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return empty

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(a_bytes), spans(b_bytes)
    links, j0 = [], 0
    for (s, e), x in zip(sa, a_ids, strict=True):
        while sb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < e:
            links.append((x, b_ids[j]))
            j += 1
    both = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, at = [], 0
    for end in both:
        own = [",".join(str(k) for (s, e), k in zip(z, ids, strict=True) if at <= s and e <= end) for z, ids in ((sa, a_ids), (sb, b_ids))]
        groups.append("|".join(own))
        at = end
    return {"n": (len(a_ids), len(b_ids), len(groups)), "links": links, "groups": hashlib.sha256(";".join(groups).encode()).hexdigest()}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_are_equal_and_give_the_whole_merge(rng, size):
    for _ in range(60):
        end = rng.randrange(1, 60)
        a = np.array(sorted({end, *(rng.randrange(1, end + 1) for _ in range(rng.randrange(end)))}))
        b = np.array(sorted({end, *(rng.randrange(1, end + 1) for _ in range(rng.randrange(end)))}))
        left, right = al.diagonals(a, b, size)
        assert set(np.diff(left + right)[:-1].tolist()) <= {size} and (left[-1], right[-1]) == (len(a), len(b))
        got_a, got_b, closes = al.aligned(a, b, size)
        spans = [list(zip([0, *x[:-1].tolist()], x.tolist(), strict=True)) for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        assert list(zip(got_a.tolist(), got_b.tolist(), strict=True)) == want
        assert a[got_a[closes]].tolist() == sorted({*a.tolist()} & {*b.tolist()})


TEXTS = [
    "Plain words, and some more of them; plain words again.",
    "two  spaces   and\ttabs\r\nand lines \n\n end ",
    " leading", "trailing ", " ", "   ", "\n", "a", "don't it's we'll",
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain here",
    "ünï çödé 漢字かな交じり文 привет мир \U0001f600\U0001f468‍\U0001f469 é",
    "under ▁ score", "x" * 300, "1234567890 3.14159 0x1F", "", None, "\x00\x01\x7f", "non breaking　spaces x",
]


def test_whole_query_equals_a_plain_loop(spark, docs_of, encoders, rng):
    letters = ["the ", "then", " an", "ing", "é", "漢", " ", "  ", "\n", "qu", "7", ",", "'s"]
    texts = [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(80)), TEXTS[0], TEXTS[0]]
    want = [brute(encoders, t) for t in texts]
    counts = Counter(p for w in want for p in w["links"])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    for known in (1, 40, al.KNOWN):  # nearly all pairs joined, some, none
        got = {r["doc_id"]: r for r in al.alignments(docs_of(texts), A, B, piece=50, known=known).collect()}
        assert len(got) == len(texts)
        for k, w in enumerate(want):
            r = got[k]
            assert (r["n_a"], r["n_b"], r["n_groups"]) == w["n"], texts[k]
            assert r["groups_sha256"] == w["groups"], texts[k]
            assert r["n_links"] == len(w["links"])
            assert r["n_best"] == sum(counts[p] == most[p[1]] for p in w["links"])
            assert r["count_sum"] == sum(counts[p] for p in w["links"])
    pairs = {(r["a_id"], r["b_id"]): (r["n_links"], r["best"]) for r in al.pair_counts(al.links(docs_of(texts), A, B)).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in counts.items()}


def test_kept_parts_are_bounded_and_cleared(encoders, monkeypatch, rng):
    monkeypatch.setattr(al, "_KEPT_IDS", 50)
    side = al.PieceTokens(B)
    for _ in range(20):
        texts = [" " + "".join(rng.choice("abcd ") for _ in range(200)) for _ in range(3)] + [" " + "z" * 500]
        ids, counts = side.of([t.encode() for t in texts])
        assert ids.tolist() == [k for t in texts for k in encoders[1].encode(t[1:])]
        assert counts.tolist() == [len(encoders[1].encode(t[1:])) for t in texts]
        assert len(side.ids) < 50 + 700


def test_edges(spark, edge_docs, no_docs, edge_rows):
    rows = al.alignments(edge_docs, A, B).collect()
    assert len(rows) == len(edge_rows)
    none = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert len({r["groups_sha256"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert al.alignments(no_docs, A, B).collect() == []
