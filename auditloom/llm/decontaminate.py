"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Every window of ``n`` benchmark words (an item of fewer words is one window) goes into a
hash set. Tasks roll a hash over the words of each whole document, look every window up,
compare the words of each hit with the benchmark's, and report or cut out what is hit.

Words: A-Z in lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

The hash set is broadcast in parts of at most ``PART_BYTES``; a benchmark of more than one
part takes one pass over the documents per part, with the parts dealt by window hash.

Edge cases: a null or empty text has no words and no hits; an item without words has no
windows; an item with a null id marks words but is never listed; repeated rows of either
table count as they stand (items are listed once); extra columns are ignored by ``leaks``
and kept by ``decontaminate``; an empty benchmark hits nothing; no documents give no
rows; a null document id is kept; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.shared import settled
from auditloom.llm.words import LETTERED, HashSet, Words, rolling, slices, window_starts

WINDOW = 10
PART_BYTES = 32 << 20
_ROW_BYTES = 100  # of a window in a task besides its words


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per benchmark window: hash, number of words, the words, item id as text."""

    def cut(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                words = Words(texts, LETTERED, fold=True)
                rows = []
                for k, (first, count) in enumerate(zip(words.bounds, words.counts, strict=False)):
                    size = min(n, int(count))
                    if size:
                        hashes = rolling(words.hashes[first : first + count], size)
                        rows += [
                            (h, size, words.phrase(first + i, size).decode(), items[at + k])
                            for i, h in enumerate(hashes.view(np.int64).tolist())
                        ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "hash": pa.array([r[0] for r in rows], pa.int64()),
                        "n": pa.array([r[1] for r in rows], pa.int32()),
                        "words": pa.array([r[2] for r in rows], pa.string()),
                        "item": pa.array([r[3] for r in rows], pa.string()),
                    }
                )

    given = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(cut, "hash long, n int, words string, item string")


class _Part:
    """The windows of one part of the benchmark, as tasks use them."""

    def __init__(self, rows: list):
        self.known: dict[int, list[tuple[bytes, str | None]]] = {}
        by_size: dict[int, list[int]] = {}
        for r in rows:
            by_size.setdefault(r["n"], []).append(r["hash"])
            self.known.setdefault(r["hash"], []).append((r["words"].encode(), r["item"]))
        self.sets = {n: HashSet(np.array(h, np.int64).view(np.uint64)) for n, h in by_size.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, set]]:
        """Verified windows: first word, number of words, items."""
        for n, members in self.sets.items():
            hashes = rolling(words.hashes, n)
            found = members.find(hashes)
            if not len(found):
                continue
            texts = words.text_of_words()
            for i in found[texts[found] == texts[found + n - 1]].tolist():
                phrase = words.phrase(i, n)
                same = [item for w, item in self.known[int(hashes[i : i + 1].view(np.int64)[0])] if w == phrase]
                if same:
                    yield i, n, {x for x in same if x is not None}


def _parts(benchmark: DataFrame, n: int, item_col: str, text_col: str, part_bytes: int) -> list:
    windows = benchmark_windows(benchmark, n, item_col, text_col)
    total = windows.agg(F.sum(F.length("words") + _ROW_BYTES)).first()[0] or 0
    count = -(-total // part_bytes)
    sc = benchmark.sparkSession.sparkContext
    return [
        sc.broadcast(_Part(windows.filter(F.pmod("hash", F.lit(count)) == k).collect()))
        for k in range(count)
    ]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per document row: its id, ``n_words``, ``spans`` (merged runs of hit words: first
    word, word after the last), ``n_hit`` words in them, and ``items`` found, sorted as text.
    """
    parts = _parts(benchmark, n, item_col, item_text_col, part_bytes)
    id_type = docs.schema[id_col].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    found = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", span),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    key = T.StructField("__id", id_type)
    text = T.StructField("__text", T.StringType())
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(part, last: bool):
        def run(batches):
            for batch in batches:
                earlier = batch.schema.names[2:] and batch.column("spans").to_pylist(), batch.schema.names[2:] and batch.column("items").to_pylist()
                for at, texts in slices(batch.column(1)):
                    words = Words(texts, LETTERED, fold=True)
                    spans = [list((s["start"], s["end"]) for s in x) for x in earlier[0][at : at + len(texts)]] or [[] for _ in texts]
                    items = [set(x) for x in earlier[1][at : at + len(texts)]] or [set() for _ in texts]
                    for i, size, names in part.value.hits(words) if part else ():
                        k = int(np.searchsorted(words.bounds, i, side="right")) - 1
                        spans[k].append((i - int(words.bounds[k]), i - int(words.bounds[k]) + size))
                        items[k] |= names
                    spans = [merged(s) for s in spans]
                    columns = {
                        "__id": batch.column(0).slice(at, len(texts)),
                        **({} if last else {"__text": batch.column(1).slice(at, len(texts))}),
                        "n_words": pa.array(words.counts, pa.int64()),
                        "n_hit": pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                        "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span_type),
                        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

        return run

    out = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    for k, part in enumerate(parts or [None]):
        last = k >= len(parts) - 1
        out = out.mapInArrow(scan(part, last), T.StructType([key, *([] if last else [text]), *found]))
        out = out if last else settled(out)
    return out.withColumnRenamed("__id", id_col)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "spans",
    n: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents, all columns, with benchmark passages removed.

    ``remove="spans"`` replaces each run of hit words by a line break, again until none is
    left, and drops a document of which no word remains; ``remove="documents"`` drops every
    document that is hit. Documents without hits are returned as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    parts = _parts(benchmark, n, item_col, item_text_col, part_bytes)
    place = docs.columns.index(text_col)
    cuts = docs.sparkSession.sparkContext.accumulator(0)

    def cleaned(part: _Part, text: bytes) -> bytes | None:
        while True:
            words = Words([text], LETTERED, fold=True)
            spans = merged([(i, i + size) for i, size, _ in part.hits(words)])
            if not spans:
                return text if len(words.starts) else None
            if remove == "documents":
                return None
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at : words.starts[s]])
                at = int(words.ends[e - 1])
            text = b"\n".join([*kept, text[at:]])

    def scan(part):
        def run(batches):
            for batch in batches:
                changed: dict[int, bytes | None] = {}
                for at, texts in slices(batch.column(place)):
                    words = Words(texts, LETTERED, fold=True)
                    hit = {int(np.searchsorted(words.bounds, i, side="right")) - 1 for i, _, _ in part.value.hits(words)}
                    changed |= {at + k: cleaned(part.value, texts[k]) for k in hit}
                if changed:
                    cuts.add(len(changed))
                    values = batch.column(place).to_pylist()
                    for k, text in changed.items():
                        values[k] = text.decode() if text is not None else None
                    batch = batch.set_column(place, batch.schema.field(place), pa.array(values, batch.schema.field(place).type))
                    gone = np.zeros(batch.num_rows, bool)
                    gone[[k for k, text in changed.items() if text is None]] = True
                    batch = batch.filter(pa.array(~gone))
                yield batch

        return run

    if len(parts) == 1:
        return docs.mapInArrow(scan(parts[0]), docs.schema)
    # a cut of one part can bring words of another part's window together, so all parts go again
    before = -1
    while parts and cuts.value != before:
        before = cuts.value
        for part in parts:
            docs = settled(docs.mapInArrow(scan(part), docs.schema))
    return docs
