import re

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import words as W


@pytest.mark.parametrize(
    ("table", "fold", "pattern"),
    [(W.SPACED, False, r"[^\x20\x09-\x0D]+"), (W.LETTERED, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")],
)
def test_words_and_hashes_are_those_of_the_pattern(rng, table, fold, pattern):
    texts = ["".join(rng.choice("aAzZ09 .\t\n\x0b\x1cé漢\U0001f600~") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts.append("long" * 700_000 + " tail")  # one word over the block size
    words = W.Words([t.encode() for t in texts], table, fold)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if fold else {}
    expected = [re.findall(pattern, t.translate(lower)) for t in texts]
    assert words.counts.tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    assert [words.word(i).decode() for i in range(len(flat))] == flat
    known = {}
    for w, h in zip(flat, words.hashes.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_rolling_hash_depends_on_the_words_only():
    h = np.arange(1, 1001, dtype=np.uint64)
    twice = W.rolling(np.concatenate([h, h]), 13)
    assert (twice[:988] == twice[1000:]).all() and len(set(twice[:988].tolist())) == 988
    assert len(W.rolling(h[:5], 6)) == 0


def test_slices_cover_all_rows_and_read_null_as_empty():
    texts = pa.array(["a" * 10, None, "", "b" * 50, "c"])
    got = list(W.slices(texts, 12))
    assert [t for _, some in got for t in some] == [b"a" * 10, b"", b"", b"b" * 50, b"c"]
    assert [at for at, _ in got] == [0, 3, 4] and list(W.slices(texts.slice(0, 0))) == []


def test_groups_join_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "x": x}) for k, x in (([1, 1], [1, 2]), ([1, 2], [3, 4]), ([], []), ([2, 3], [5, 6]))]
    batches[2] = batches[0].slice(0, 0)
    assert [t.column("x").to_pylist() for t in W.groups(iter(batches), "k")] == [[1, 2, 3], [4, 5], [6]]
