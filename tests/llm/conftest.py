import random

import pytest

#: Names that operators use inside; a user's table may have them too.
CLASHING = [
    "id", "node", "a", "b", "u", "v", "chunk", "place", "data", "band", "bands", "pair", "found", "spans", "kept",
    "n_words", "n_hit", "items", "score", "accepted", "piece", "length", "offset", "sequence_id", "__id", "__shard",
    "x", "y", "teacher", "block", "shard", "component", "component_id", "rank", "hash", "words", "item", "part", "gap",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)

LONG = " ".join(f"w{i % 7919}x{i}" for i in range(150_000))  # over a megabyte


def document(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), *("same",) * len(CLASHING))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, repeated rows and a null id."""
    text = "Some plain words that make up a short text, said by jane.doe@mail.example.com on the phone, and a few more of them."
    return [
        document(1, None, None, None),
        document(2, ""),
        document(3, " \n\t "),
        document(4, text),
        document(4, text),
        document(5, text),
        document(None, text),
        document(None, None),
        document(6, LONG, "fr"),
        document(7, "é ü 漢字 \U0001f600 word", "xx"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts):
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        return spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")

    return make
