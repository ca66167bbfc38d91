"""Language identification with hyperdimensional profiles.

Every character has a fixed random vector of +1 and -1. The vector of a trigram binds three
of them: the first rotated twice, the second once, multiplied place by place. A text bundles
(sums) its trigrams; a language's prototype bundles its texts, each scaled to length one, and
is centred on the mean of all prototypes, so that what languages share does not count. A text
gets the language whose prototype has the largest cosine with its centred vector.

Bundles are sums, so tasks count trigrams first and touch vectors once per different trigram;
prototypes are added up in each task before one row per task and language is shuffled.

Texts are lower-cased; runs of anything but letters are one blank. Edge cases: a null text or
one without letters is ``und`` with score 0; texts of no known language train nothing; with
no training texts everything is ``und``; equal cosines go to the smaller name; repeated rows
count as they stand; a null id is kept; texts of any length are taken whole; other columns
are ignored; no rows train nothing and give none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import slices

DIMENSIONS = 512
UNKNOWN = "und"
_BLANK = 0x20
_DENSE, _COLUMNS = 1 << 23, 4096
_DENSE_CELLS, _ENTRIES = 1 << 23, 1 << 14


@lru_cache(100_000)
def _character(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([7, code]).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """The code of each letter (lower case); zero for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and trigram number of each trigram, the different trigrams, letters per text."""
    decoded = [t.decode("utf-8") for t in texts]
    codes = np.frombuffer("\n".join([*decoded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, decoded), np.int64, len(texts)) + 1)
    letters = _letters()[codes]
    is_letter = letters > 0
    n_letters = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of blanks
    seen, owner = np.where(is_letter, letters, _BLANK)[keep], owner[keep]
    present = np.zeros(0x110000, bool)
    present[seen] = True
    alphabet = np.flatnonzero(present)
    rank = np.zeros(0x110000, np.int32)
    rank[alphabet] = np.arange(len(alphabet))
    seen = rank[seen].astype(np.int64)
    a = len(alphabet)
    keys = (seen[:-2] * a + seen[1:-1]) * a + seen[2:]
    inside = owner[:-2] == owner[2:]
    keys, owner = keys[inside], owner[:-2][inside]
    if a**3 <= _DENSE:
        there = np.zeros(a**3, bool)
        there[keys] = True
        different = np.flatnonzero(there)
        place = np.zeros(a**3, np.int32)
        place[different] = np.arange(len(different))
        column = place[keys]
    else:
        different, column = np.unique(keys, return_inverse=True)
    names = (alphabet[different // (a * a)] << 42) | (alphabet[different // a % a] << 21) | alphabet[different % a] if a else different
    return owner, column, names, n_letters


class Counts:
    """How often each text has each of its trigrams, in the order of trigrams and texts."""

    def __init__(self, texts: list[bytes]):
        owner, column, self.names, self.n_letters = trigrams(texts)
        self.n = len(texts)
        keys, times = np.unique(column.astype(np.int64) * max(1, self.n) + owner, return_counts=True)
        self.column, self.text = np.divmod(keys, max(1, self.n))
        self.times = times.astype(np.float32)

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.text, weights=np.square(self.times), minlength=self.n))

    def blocks(self):
        """At most ``_COLUMNS`` trigrams at a time: their names, and text, column and count of each entry."""
        for at in range(0, len(self.names), _COLUMNS):
            s, e = np.searchsorted(self.column, (at, at + _COLUMNS))
            yield self.names[at : at + _COLUMNS], self.text[s:e], self.column[s:e] - at, self.times[s:e]


def _vectors(names: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigrams: the letters' vectors, shifted by their place and multiplied."""
    codes, place = np.unique(np.stack([(names >> s) & 0x1FFFFF for s in (42, 21, 0)]), return_inverse=True)
    letters = np.stack([_character(c, dimensions) for c in codes.tolist()])
    first, second, third = place.reshape(3, len(names))
    return (np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]).astype(np.float32)


def _add(out: np.ndarray, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
    """Adds to each row of ``out`` its weighted vectors: as a matrix product where that is small, else entry by entry."""
    if len(out) * len(vectors) <= max(_DENSE_CELLS, 16 * len(rows)):
        table = np.bincount(rows * len(vectors) + columns, weights=weights, minlength=len(out) * len(vectors))
        out += table.reshape(len(out), len(vectors)).astype(np.float32) @ vectors
        return
    order = np.argsort(rows, kind="stable")
    for at in range(0, len(order), _ENTRIES):
        some = order[at : at + _ENTRIES]
        starts = np.flatnonzero(np.diff(rows[some], prepend=-1))
        out[rows[some][starts]] += np.add.reduceat(vectors[columns[some]] * weights[some, None], starts)


def bundles(texts: list[bytes], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text (zero without trigrams) and its number of letters."""
    counts = Counts(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    for names, text, column, times in counts.blocks():
        _add(out, text, column, times, _vectors(names, dimensions))
    return out, counts.n_letters


def language_sums(texts: list[bytes], languages: np.ndarray, dimensions: int) -> dict[str, np.ndarray]:
    """The sum of the texts' vectors by language, each text scaled by the length of its counts."""
    counts = Counts(texts)
    norms = counts.norms()
    scale = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
    known, place = np.unique(languages, return_inverse=True)
    out = np.zeros((len(known), dimensions))
    for names, text, column, times in counts.blocks():
        weights = np.bincount(place[text] * len(names) + column, weights=times * scale[text], minlength=len(known) * len(names))
        out += weights.reshape(len(known), len(names)).astype(np.float32) @ _vectors(names, dimensions)
    return dict(zip(known.tolist(), out, strict=True))


def prototypes(
    docs: DataFrame, trained: Column, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS
) -> dict[str, np.ndarray]:
    """The sum of the vectors of each language's texts, over all rows for which ``trained``."""

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for at, texts in slices(batch.column(1)):
                for name, total in language_sums(texts, names[at : at + len(texts)], dimensions).items():
                    sums[name] = sums.get(name, 0) + total
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * dimensions),
                    pa.array(np.arange(dimensions), pa.int32()),
                    pa.array(np.rint(total * (1 << 20)).astype(np.int64)),  # whole numbers: any order of adding
                ],
                ["lang", "place", "part"],
            )

    given = docs.filter(trained & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")
    )
    rows = given.mapInArrow(add, "lang string, place int, part long").groupBy("lang", "place").agg(F.sum("part").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "v")))["v"].alias("v")).toLocalIterator():
        found[r["lang"]] = np.array(r["v"], np.float64) / (1 << 20)
    return {name: v for name, v in sorted(found.items()) if np.any(v)}


class Model:
    """Centred prototypes, ready to compare."""

    def __init__(self, sums: dict[str, np.ndarray], dimensions: int):
        self.names = sorted(sums)
        rows = np.array([sums[n] / np.linalg.norm(sums[n]) for n in self.names]).reshape(-1, dimensions)
        self.mean = rows.mean(0) if len(rows) > 1 else np.zeros(dimensions)
        rows = rows - self.mean
        self.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its cosine, cut off at 0 and 1."""
        lengths = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        centred = vectors.astype(np.float64) / lengths - self.mean
        centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        cosines = centred @ self.rows.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)


def identify(
    docs: DataFrame, sums: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS
) -> DataFrame:
    """Per document row: its id, ``lang_pred`` and ``score``."""
    model = docs.sparkSession.sparkContext.broadcast(Model(sums, dimensions)) if sums else None

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model:
                    vectors, letters = bundles(texts, dimensions)
                    best, scores = model.value.predict(vectors)
                    names = [model.value.names[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
                    scores = np.where(letters > 0, scores, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(scores)],
                    ["id", "lang_pred", "score"],
                )

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
