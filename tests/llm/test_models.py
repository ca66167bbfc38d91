"""Language and quality: held-out accuracy on the given tables, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import language, quality
from auditloom.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language


def test_language_of_held_out_documents(spark):
    got = QUERIES["op5_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and 250 < len(held) < 420
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0.0 <= r["score"] <= 1.0 for r in got)


def test_trigrams_are_counted_as_by_hand():
    texts = ["Ab c", "", "a", "ÄB\n\nc!", "12 .", "x" * 20]
    owner, column, names, letters = language.trigrams([t.encode() for t in texts])
    counted = {}
    for o, c in zip(owner.tolist(), column.tolist(), strict=True):
        key = "".join(chr((int(names[c]) >> s) & 0x1FFFFF) for s in (42, 21, 0))
        counted[o, key] = counted.get((o, key), 0) + 1
    expected = {}
    for o, t in enumerate(texts):
        folded = "".join(x.lower() if x.isalpha() else " " for x in t + "\n")
        while "  " in folded:
            folded = folded.replace("  ", " ")
        folded = folded.lstrip(" ") if not t[:1].isalpha() else folded
        for k in range(len(folded) - 2):
            expected[o, folded[k : k + 3]] = expected.get((o, folded[k : k + 3]), 0) + 1
    assert counted == expected and letters.tolist() == [3, 0, 1, 3, 0, 20]


def test_bundle_is_the_sum_of_bound_and_rotated_letters():
    vectors, _ = language.bundles([b"abca"], 64)
    of = lambda c: language._character(ord(c), 64).astype(int)
    expected = sum(np.roll(of(x), 2) * np.roll(of(y), 1) * of(z) for x, y, z in ("abc", "bca", "ca "))
    assert (vectors[0] == expected).all()


def test_scripts_beyond_the_dense_table_agree():
    texts = [("".join(chr(0x4E00 + (i * k) % 900) for i in range(400))).encode() for k in (1, 7)]
    vectors, letters = language.bundles(texts, 64)
    assert letters.tolist() == [400, 400] and np.linalg.norm(vectors, axis=1).min() > 0


def test_language_edge_cases(spark, edge_docs, no_docs):
    sums = language.prototypes(edge_docs, F.lit(True))
    assert set(sums) == {"en", "fr", "xx"}
    got = {r["doc_id"]: r for r in language.identify(edge_docs, sums).collect()}
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and got[7]["lang_pred"] == "xx" and language.identify(edge_docs, sums).count() == 10
    assert language.prototypes(no_docs, F.lit(True)) == {} and language.identify(no_docs, sums).collect() == []
    assert {r["lang_pred"] for r in language.identify(edge_docs, {}).collect()} == {"und"}


# ------------------------------------------------------------------ quality


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        rows.append((i, (". " if good else " ").join(w.capitalize() if good else f"{w}###" for w in words), "en", f"src{i % 5}", int(good)))
    return rows


def test_quality_of_documents_that_were_not_trained_on(spark):
    rows = made(900, 1)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3 == 0], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    unseen = [r for r in rows if r[0] % 3]
    assert sum(got[r[0]]["accepted"] == bool(r[4]) for r in unseen) >= 0.98 * len(unseen)
    kept = {r["doc_id"] for r in quality.accepted(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if r["accepted"]}


def test_views_exchange_labels_of_unlabelled_documents_only(spark):
    rows = made(600, 2)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    assert quality.co_train(quality.features(docs), labels).exchanged == [(0, 0)] * quality.ROUNDS
    model = quality.co_train(quality.features(docs), labels.filter("doc_id < 60"))
    assert len(model.exchanged) == quality.ROUNDS and max(map(max, model.exchanged)) > 0


def test_given_documents_of_good_quality_are_kept(spark):
    got = QUERIES["op8_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    good = [r for r in got if r["quality"]]
    assert sum(r["accepted"] for r in good) >= 0.98 * len(good)
    bad = [r for r in got if not r["quality"]]
    assert sum(not r["accepted"] for r in bad) >= 0.8 * len(bad)


def test_toxic_documents_without_a_label_are_not_kept(spark):
    rng, insults = random.Random(3), ["idiotx", "moronx", "scumx", "trashx"]
    rows = []
    for i, (_, text, lang, source, good) in enumerate(made(900, 4)):
        toxic = rng.random() < 0.2
        words = text.split(" ")
        for w in rng.sample(insults, 2) if toxic else []:
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), lang, source, good, int(toxic)))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], r[5] if r[0] % 30 else None) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    unseen = [r for r in rows if r[0] % 2 == 0 and r[4]]
    assert sum(not got[r[0]]["kept"] for r in unseen if r[5]) >= 0.95 * sum(r[5] for r in unseen)
    assert sum(got[r[0]]["kept"] for r in unseen if not r[5]) >= 0.97 * sum(1 - r[5] for r in unseen)
    assert {r["doc_id"] for r in quality.accepted(docs, labels).collect()} == {k for k, r in got.items() if r["kept"]}


def test_views_give_a_row_for_each_text():
    texts = [b"", b"a", b"two words", b"\n"]
    text, page = quality.text_view(texts), quality.metadata_view(texts, [None, "en", "en", "de"], ["s", None, "s", "s"])
    assert text.shape == (4, quality._WIDTHS[0]) and page.shape == (4, quality._WIDTHS[1])
    assert np.isfinite(text).all() and np.isfinite(page).all()


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(4, None), (5, 0)], [(None, 1), (999, 0)]])
def test_quality_edge_cases(spark, edge_docs, labels):
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    for clashing in ("score", "id", "y", "order"):
        given = given.withColumn(clashing, F.lit("same"))
    got = quality.scores(edge_docs, given).collect()
    assert len(got) == 10 and all(r["accepted"] and r["score"] == 1.0 for r in got)
    kept = quality.accepted(edge_docs, given)
    assert kept.count() == 10 and kept.schema == edge_docs.schema


def test_quality_with_conflicting_labels_and_missing_columns(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (1, 0), (2, 0), (6, 1)], "doc_id long, quality int")
    assert quality.scores(edge_docs, labels).count() == 10
    assert quality.scores(edge_docs.select("doc_id", "text"), labels).count() == 10
    assert quality.scores(no_docs, labels).collect() == [] and quality.accepted(no_docs, labels).collect() == []
