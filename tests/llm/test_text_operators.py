"""Decontamination, repeats, secrets, licenses, personal data: against brute force and on edge cases."""

import hashlib
import re

import pytest

from auditloom.llm import decontaminate, licenses, pii, repeats, secret_scan
from tests.llm.conftest import SCHEMA, document

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# ------------------------------------------------------------------ decontamination


def brute_leaks(docs, items, n=10):
    out = []
    for i, text in docs:
        words, hit, found = lettered(text), set(), set()
        for item, body in items:
            w = lettered(body)
            size = min(n, len(w))
            windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
            for k in range(len(words)):
                if size and tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leak_case():
    import random

    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "é", "x9", "the", "OF"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 12, 25])))) for k in range(12)]
    items += [(3, items[3][1]), (None, "lonely item of ten words in all, no less, no more"), (50, ""), (51, None)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        parts += [re.sub(" ", rng.choice([" ", "-", "\n"]), rng.choice(items)[1] or "").upper() for _ in range(rng.randint(0, 2))]
        docs.append((i, " ".join(parts)))
    return [*docs, (60, None), (61, ""), (0, docs[0][1])], items


@pytest.mark.parametrize("part_bytes", [1 << 25, 4000])
def test_leaks_equal_brute_force(spark, docs_of, leak_case, part_bytes):
    docs, items = leak_case
    found = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes
    )
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=repr)
    assert got == brute_leaks(docs, items)
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in found.collect())


@pytest.mark.parametrize("part_bytes", [1 << 25, 4000])
def test_decontaminated_documents_have_no_leak_and_clean_ones_stay(spark, leak_case, part_bytes):
    docs, items = leak_case
    items = [i for i in items if len(lettered(i[1])) >= 9]
    given, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    before = {i: n for i, _, n, _ in brute_leaks(docs, items)}
    kept = [tuple(r) for r in decontaminate.decontaminate(given, benchmark, part_bytes=part_bytes).collect()]
    assert not any(n for _, _, n, _ in brute_leaks(kept, items))
    assert [d for d in sorted(kept, key=repr) if not before[d[0]]] == [d for d in sorted(docs, key=repr) if not before[d[0]]]
    whole = decontaminate.decontaminate(given, benchmark, remove="documents", part_bytes=part_bytes).collect()
    assert sorted(map(tuple, whole), key=repr) == [d for d in sorted(docs, key=repr) if not before[d[0]]]


def test_leaks_edge_cases(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "plain words that make up a short text said by")], "item_id long, text string")
    got = decontaminate.leaks(edge_docs, benchmark).collect()
    assert len(got) == 10 and sorted(r["n_hit"] for r in got) == [0] * 6 + [10] * 4
    assert decontaminate.leaks(no_docs, benchmark).collect() == []
    assert {r["n_hit"] for r in decontaminate.leaks(edge_docs, benchmark.limit(0)).collect()} == {0}
    cleaned = decontaminate.decontaminate(edge_docs, benchmark)
    assert cleaned.schema == edge_docs.schema and cleaned.count() == 10
    assert decontaminate.decontaminate(edge_docs, benchmark.limit(0)).count() == 10
    with pytest.raises(ValueError, match="remove"):
        decontaminate.decontaminate(edge_docs, benchmark, remove="lines")


# ------------------------------------------------------------------ repeats


def brute_repeats(docs, window=13):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "ranges"), [(8 << 20, 12 << 20), (700, 900)])
def test_repeats_equal_brute_force_in_any_chunks(spark, rng, chunk, ranges):
    passages = [[f"p{rng.randint(0, 99)}" for _ in range(rng.randint(12, 60))] for _ in range(8)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 9))]
            p = rng.choice(passages)
            cut = rng.randint(0, 6)
            w += p[cut : len(p) - rng.randint(0, 4)]
        docs.append((i * 3 % 101, rng.choice([" ", "\n", "\t "]).join(w)))  # some ids twice
    docs += [(200, None), (201, ""), (None, docs[0][1]), (202, "a " * 40), (203, "a " * 40)]
    found = repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=chunk, range_bytes=ranges).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == brute_repeats(docs)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in found)


def test_repeats_edge_cases(edge_docs, edge_rows, no_docs):
    found = repeats.without_repeats(edge_docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == brute_repeats([r[:2] for r in edge_rows])
    assert repeats.without_repeats(no_docs).collect() == []


# ------------------------------------------------------------------ secrets


def slow_base(text):
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    out = [("assign", *m.span()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_equal_the_plain_patterns(rng):
    bits = ["token", "Secret", "API_KEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "beef", "ſecret", "é", "\n"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert [f[:3] for f in secret_scan.scan(text) if f[0] != "named"] == slow_base(text)


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        ('client_secret = "Zx81kkQpL0vb"', ["Zx81kkQpL0vb"]),
        ('material = "Zx81kkQpL0vb"\nclient_secret = material', ["Zx81kkQpL0vb"]),
        ('a = "Zx81kkQp"\nb = a\nsigning_key = b + "L0vbn2w9"', ["Zx81kkQp", "L0vbn2w9"]),
        ('key_part = "Zx81kkQpL0vb"\nsecret = "${key_part}"', ["Zx81kkQpL0vb"]),
        ("export DB_PASSWORD=Hunter2Hunter2", ["Hunter2Hunter2"]),
        ("db.password: s3cr3tValue99", ["s3cr3tValue99"]),
        ('config["api_key"] = "part1ABC9"', ["part1ABC9"]),
        ('{"privateKey": "MIIEvQIBADANBgkq", "publicKey": "MIIEvQIBADANBgkq"}', ["MIIEvQIBADANBgkq"]),
        ("<password>Tr0ub4dor&3xyz</password>", ["Tr0ub4dor&3xyz"]),
        ('let authToken: string = "abcDEF123456";', ["abcDEF123456"]),
        ("token_count = 1234567890123", []),
        ("password = changeme", []),
        ("password = your_password_here", []),
        ("see: https://example.org/a", []),
        ("x = 1\ny: z", []),
    ],
)
def test_named_literals(text, literals):
    assert [text[s:e] for kind, s, e, _, _ in secret_scan.scan(text) if kind == "named"] == literals


def test_secrets_edge_cases(edge_docs, no_docs):
    found = secret_scan.secrets(edge_docs).collect()
    assert len(found) == 10 and all(r["found"] == [] for r in found)
    assert secret_scan.secrets(no_docs).collect() == []


# ------------------------------------------------------------------ licenses


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(row[k], last[k + 1])
    return row[-1]


def test_banded_alignment_is_the_longest_common_subsequence_near_the_diagonal(rng):
    import numpy as np

    for _ in range(300):
        a = [rng.randint(0, 5) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(1, 9))]
        n, s, e = licenses.align(np.array(a), np.array(b), 0, 20)
        assert n == longest_common(a, b)
        assert not n or longest_common(a, b[s : e + 1]) == n


def test_notices_with_changed_words_are_found_with_their_spans(docs_of):
    texts = [
        "Start. Licensed under the very Apache License, version 2.0. End",
        "é Released under the MIT License.",
        "no license here, and none under the sun",
        None,
        "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE VERSION 3 and released under the mit license",
    ]
    found = {r["doc_id"]: [(f["license"], texts[r["doc_id"]][f["start"] : f["end"]]) for f in r["found"]] for r in licenses.licenses(docs_of(texts)).collect()}
    assert found == {
        0: [("Apache-2.0", "Licensed under the very Apache License, version 2.0")],
        1: [("MIT", "Released under the MIT License")],
        2: [],
        3: [],
        4: [("GPL-3.0", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE VERSION 3"), ("MIT", "released under the mit license")],
    }


def test_notices_do_not_depend_on_neighbours():
    from auditloom.llm.words import LETTERED, Words

    index = licenses.Index(licenses.TEMPLATES)

    def scanned(texts):
        words = Words([t.encode() for t in texts], LETTERED, fold=True)
        found = licenses.matches(index, words, licenses.COVERAGE)
        return [[(n, c, s - words.bounds[k], e - words.bounds[k]) for n, c, s, e in found.get(k, [])] for k in range(len(texts))]

    short, opened = "Released under the MIT License.", "some words, licensed under the"
    texts = [short] * 60 + [opened, "MIT License", opened, "Licensed under the MIT License", "x " + short, short * 2] * 20
    got = scanned(texts)
    assert got == [scanned([t])[0] for t in texts]
    assert all(len(g) == t.count(short) for t, g in zip(texts, got, strict=True) if short in t)
    assert [s for _, _, s, _ in scanned([" ".join([short] * 50)])[0]] == [*range(0, 250, 5)]


GNU = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by"
    " the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution.\n{}\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
)
HEADERS = [
    (GNU.format("General Public License", "2"), "GPL-2.0"),
    (GNU.format("General Public License", "3"), "GPL-3.0"),
    (GNU.format("Library General Public License", "2"), "LGPL-2.0"),
    (GNU.format("Lesser General Public License", "2.1"), "LGPL-2.1"),
    (GNU.format("Lesser General Public License", "3"), "LGPL-3.0"),
    (GNU.format("Affero General Public License", "3"), "AGPL-3.0"),
    ("it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "GPL-2.0"),
    ("licensed under the GNU Lesser General Public License", "LGPL"),
    ("Licensed under the GNU General Public License.", "GPL"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999", "LGPL-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007", "AGPL-3.0"),
    ("Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/", "Apache-2.0"),
    (BSD.format(""), "BSD-2-Clause"),
    (BSD.format("3. Neither the name of the Foo Corp nor the names of its contributors may be used to endorse or promote products"
     " derived from this software without specific prior written permission."), "BSD-3-Clause"),
    (BSD[: BSD.index(":")], "BSD"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"),
    ("# SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC-BY-SA-3.0"),
    ("# SPDX-License-Identifier: CECILL-2.0", None),
    ("Licensed under the Foo License", None),
]


@pytest.mark.parametrize(("text", "label"), HEADERS)
def test_labels_of_standard_headers(text, label):
    from auditloom.llm.words import LETTERED, Words

    words = Words([f"Some words before. {text} And some after.".encode()], LETTERED, fold=True)
    found = licenses.matches(licenses.Index(licenses.TEMPLATES), words, licenses.COVERAGE)
    assert [f[0] for f in found.get(0, [])] == ([label] if label else [])


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_each_template_is_found_under_its_own_label(label):
    from auditloom.llm.words import LETTERED, Words

    index = licenses.Index(licenses.TEMPLATES)
    for notice in licenses.TEMPLATES[label]:
        found = licenses.matches(index, Words([notice.encode()], LETTERED, fold=True), licenses.COVERAGE)
        assert [f[0] for f in found.get(0, [])] == [label], notice


def test_licenses_edge_cases(edge_docs, no_docs):
    found = licenses.licenses(edge_docs).collect()
    assert len(found) == 10 and all(r["found"] == [] for r in found)
    assert licenses.licenses(no_docs).collect() == [] and licenses.licenses(edge_docs, templates={}).count() == 10
    with pytest.raises(ValueError, match="templates"):
        licenses.licenses(edge_docs, templates={"x": ["w " * 100_001]})


# ------------------------------------------------------------------ personal data


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation_without_fixed_points_and_turns_back(size):
    out = [pii.feistel(i, size, b"k", "t") for i in range(size)]
    assert sorted(out) == list(range(size)) and all(a != b for a, b in enumerate(out))
    assert [pii.feistel(x, size, b"k", "t", forward=False) for x in out] == list(range(size))
    assert out != [pii.feistel(i, size, b"other", "t") for i in range(size)] or size < 4


VALUES = {
    "email": ["the.65@mail7.example.com", "É.x+1@ÖSTER.example.de"],
    "phone": ["+1 (068) 555-2748", "(212) 555-0199", "212-555-0199", "+49 30 123456"],
    "card": ["4928819459423830", "4111 1111 1111 1111"],
    "ipv4": ["238.202.104.165"],
    "date": ["1980-02-29", "31.12.1999", "12/25/2020"],
    "iban": ["GB82 WEST 1234 5698 7654 32"],
    "ssn": ["123-45-6789"],
}


def test_values_become_valid_values_of_the_same_layout_and_equal_ones_stay_equal():
    layout = lambda t: re.sub("[0-9]", "9", re.sub("[a-zà-ÿ]", "a", re.sub("[A-ZÀ-Þ]", "A", t)))
    for kind, values in VALUES.items():
        for value in values:
            text = f"x {value}, {value} y"
            one, two = pii.pseudonyms(text, b"k")
            assert one[0] == two[0] == kind and one[3] == two[3] != value
            if kind != "ipv4":
                assert layout(one[3]) == layout(value)
            assert [f[0] for f in pii.pseudonyms(f"x {one[3]} y", b"k")] == [kind]  # valid again
            new = pii.replaced(text, [one, two])
            assert pii.replaced(new, pii.pseudonyms(new, b"k", forward=False)) == text
    assert pii.pseudonyms("4111-1111-1111-1111", b"k")[0][3].replace("-", "") == pii.pseudonyms("4111111111111111", b"k")[0][3]


@pytest.mark.parametrize("text", ["4928819459423831", "999.1.1.1", "2024-13-01", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "9c8b45435718dcc7", "v1.2.3", "12345"])
def test_invalid_values_stay(text):
    assert pii.pseudonyms(f"a {text} b", b"k") == []


def test_pii_edge_cases(edge_docs, no_docs):
    found = pii.find_values(edge_docs, "key").collect()
    assert len(found) == 10 and sorted(len(r["found"]) for r in found) == [0] * 6 + [1] * 4
    assert len({r["text"] for r in found if r["found"]}) == 1
    assert {r["text"] for r in found if r["doc_id"] == 1} == {None}
    changed = pii.pseudonymised(edge_docs, "key")
    assert changed.schema == edge_docs.schema
    back = pii.pseudonymised(changed, "key", forward=False)
    digest = lambda df: sorted(hashlib.sha256(repr(tuple(r)).encode()).hexdigest() for r in df.collect())
    assert digest(back) == digest(edge_docs) != digest(changed)
    assert pii.find_values(no_docs, "key").collect() == [] and pii.pseudonymised(no_docs, "key").collect() == []


def test_clashing_fixture_has_all_names():
    assert len(document(1, "x")) == len(SCHEMA.split(","))


def test_rows_without_an_id_keep_their_words(spark):
    texts = [None, "", " \t ", "a  b\x0bc\r\n", " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(40)), "é\u00a0x y"]
    rows = [(None, t) for t in texts] + [(1, texts[4]), (2, texts[4])]
    got = sorted(map(tuple, repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    words = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    assert got == sorted([(None, len(w), 0, " ".join(w)) for w in words] + [(1, 40, 0, texts[4]), (2, 40, 40, "")], key=repr)
