"""Single texts that are long, odd or of a large alphabet: time linear in the length, bounded memory."""

import datetime
import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from auditloom.llm import language, packing, pii, secret_scan
from auditloom.llm.queries import tokenizer

KEY = pii._key("a key")


def changed(text, forward=True):
    return pii.replaced(text, pii.pseudonyms(text, KEY, forward))


@pytest.mark.parametrize(
    "text",
    ["a" * 3100 + "@example.com", "a" * 1_000_000 + "@x.com", "a@" * 300_000, "x@" + "a." * 300_000, "1990/12/25 " * 5000, "é" * 500_000 + "@é.fr"],
    ids=range(6),
)
def test_pseudonyms_of_long_words(text):
    start = time.perf_counter()
    assert changed(changed(text), False) == text
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("address", ["иван@пример.com", "müßß@ßß.de", "Γιώργος@παράδειγμα.gr", "ÀÉÎ.x1@Ünï.org", "名前@例え.jp", "a_b+c@d-e.co.uk"])
def test_every_letter_of_an_address_may_change(address):
    new = changed(f"write to {address} now")
    (kind, start, end, made), = pii.pseudonyms(f"write to {address} now", KEY)
    assert kind == "email" and address not in new and changed(new, False) == f"write to {address} now"
    assert [c.isalnum() for c in made] == [c.isalnum() for c in address] and end - start == len(address)
    assert [c.isupper() for c in made] == [c.isupper() for c in address]


@pytest.mark.parametrize(
    ("text", "order"),
    [("25/12/1990", "dmy"), ("3/5/1990", "mdy"), ("1990/12/25", "ymd"), ("1.2.1990", "dmy"), ("05/04/1991", "mdy"), ("2020-1-5", "ymd"), ("3/28/1990", "mdy"), ("31/1/2001", "dmy")],
)
def test_dates_stay_in_their_layout(text, order):
    (kind, start, end, new), = pii.pseudonyms(text, KEY)
    assert kind == "date" and (start, end) == (0, len(text)) and new != text
    assert [len(n) for n in re.split("[/.-]", new)] == [len(n) for n in re.split("[/.-]", text)]
    part = dict(zip(order, map(int, re.split("[/.-]", new)), strict=True))
    assert 1900 <= datetime.date(part["y"], part["m"], part["d"]).year < 2100
    assert changed(new, False) == text


def test_every_late_day_comes_out_once():
    days, _ = pii._days(False, True, False)
    texts = {f"{d.day}.{d.month:02d}.{d.year}" for d in (pii._FIRST + datetime.timedelta(days=k) for k in days)}
    assert {changed(t) for t in texts} == texts


@pytest.mark.parametrize("text", ["31/31/1990", "30/2/1990", "1990/13/01", "/1990/12/25", "0/1/1990"])
def test_what_is_no_date_stays(text):
    assert pii.pseudonyms(text, KEY) == []


@pytest.mark.parametrize(
    "text",
    [
        r"{\"a\": \"b c\", \"password\": \"hunter2hunter2X9\"}" * 20_000,
        '"' + r"\"x" * 300_000,
        'x = "abcDEF123456ghi"\n' + "x = x + x\n" * 40,
        'p = "q"\n' + 'p = p + "aB3dE5gH7jK9"\n' * 20_000,
        'p = "aB3dE5gH7jK9mN1"\n' + "".join(f"q{i} = p\n" for i in range(20_000)),
        "token: |\n" + "  line\n" * 50_000,
        '"""' + "'" * 100_000,
    ],
    ids=range(7),
)
def test_lexing_is_linear(text):
    start = time.perf_counter()
    secret_scan.scan(text)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('password = """s3cr3tV4lue99"""', ["s3cr3tV4lue99"]),
        ("secret = '''\n  s3cr3tV4lue99\n'''", ["s3cr3tV4lue99"]),
        ("password: |\n  s3cr3tV4lue99xYz\n  an0th3rOne77ab\nnext: v4lueThat1sNot9\n", ["s3cr3tV4lue99xYz", "an0th3rOne77ab"]),
        ("- token: >-\n    s3cr3tV4lue99xYz\n", ["s3cr3tV4lue99xYz"]),
        (r"{\"password\": \"hunter2hunter2X9\"}", ["hunter2hunter2X9"]),
        ('base = "aB3dE5gH7jK9mN1"\nother = base\npassword = other\n', ["aB3dE5gH7jK9mN1"]),
        ("token: |\n", []), ('password = """', []), ("key: >-\n\n", []),
    ],
)
def test_literals_over_lines(text, found):
    assert [text[s:e] for kind, s, e, *_ in secret_scan.scan(text) if kind == "named"] == found


def test_a_literal_is_given_again_to_more_sensitive_names_only():
    text = 'a = "aB3dE5gH7jK9mN1"\nb = a\nsalt = b\nc = salt\npassword = c\npwd = password\n'
    assert [n for n, *_ in secret_scan.pairs(text)] == ["a", "salt", "password"]


def chinese(n, size, seed=3):
    rng = random.Random(seed)
    return ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(size)).encode() for _ in range(n)]


@pytest.mark.parametrize(("n", "size"), [(3400, 100), (1, 340_000)])
def test_profiles_of_a_large_alphabet_take_little_memory(n, size):
    texts = chinese(n, size)
    language.bundles(texts[:1], 64)
    tracemalloc.start()
    language.bundles(texts, 512)
    language.language_sums(texts, np.array(["zh"] * n), 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6


def test_sums_and_bundles_equal_a_loop_over_trigrams():
    texts = [*chinese(5, 300), b"plain words here, plain words", b"", "ünï ".encode() * 50]
    vectors, _ = language.bundles(texts, 128)
    sums = language.language_sums(texts, np.array(list("aabbabab")), 128)
    owner, column, names, _ = language.trigrams(texts)
    counts = np.zeros((len(texts), len(names)))
    np.add.at(counts, (owner, column), 1)
    expected = counts @ language._vectors(names, 128)
    assert np.allclose(vectors, expected, atol=1e-3)
    norms = np.sqrt((counts**2).sum(1))
    scaled = expected / np.where(norms > 0, norms, 1)[:, None]
    for name in "ab":
        assert np.allclose(sums[name], scaled[[i for i, x in enumerate("aabbabab") if x == name]].sum(0), atol=1e-3)


@pytest.mark.parametrize("small", [0, 1])
def test_both_ways_to_add_entries_agree(small, monkeypatch):
    texts = [*chinese(40, 60), b"some words", b""]
    whole, _ = language.bundles(texts, 64)
    monkeypatch.setattr(language, "_DENSE_CELLS", 0)
    monkeypatch.setattr(language, "_ENTRIES", 7 + small)
    assert np.allclose(language.bundles(texts, 64)[0], whole, atol=1e-3)


def test_kept_tokens_are_bounded_by_ids(monkeypatch):
    monkeypatch.setattr(packing, "_KEPT_IDS", 10_000)
    table, largest = packing.Tokens(tokenizer()), 0
    for text in chinese(30, 3000):
        ids, counts = table.of([text])
        largest = max(largest, len(table.ids))
        assert counts.tolist() == [len(ids)] and table.tokenizer.decode(ids.tolist()).encode() == text
    assert largest < 10_000 + 12_000
