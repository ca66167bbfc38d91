"""Removal of passages that repeat across documents, with fixed-block anchors.

A passage of ``WINDOW`` (2n - 1) words, wherever it starts, contains one whole block of n
words of its document's grid. So every document indexes its non-overlapping blocks of n words
and probes the index with every rolling window of n words: each passage that two documents
share is hit in both. Passages around a hit are candidates; they are compared as wholes by a
96-bit fingerprint, and those that also start in a document with a smaller id are marked.
Marked passages that overlap or touch make up the maximal repeats, whose words go.

The work is one shuffle of the texts, into chunks of documents by id hash, and two rounds of
questions and answers. A chunk asks about each different hash once, however often it has it,
and packs its questions into one row per range of hashes; the task of a range answers with
one bit per question. Chunks and ranges hold a bounded number of words whatever the input;
a passage in very many documents is one question per chunk.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Edge cases: a null or empty text has no words;
documents of fewer words than a window lose nothing; a document with a null id neither loses
words nor makes others lose any; rows repeated with one id keep theirs, as neither id is
smaller; texts of any length are taken whole; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import SPACED, Words, mixed, rolling, slices

WINDOW = 13
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 12 << 20


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: equal high bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(data: memoryview, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


class _Grouped:
    """Hashes by value: the order, the group of each entry, one value per group."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        ordered = hashes[self.order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
        self.starts = np.flatnonzero(new)
        self.values = ordered[self.starts]
        self.group = np.empty(len(hashes), np.int64)
        self.group[self.order] = np.cumsum(new) - 1

    def per_group(self, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
        return reduce.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]


class _Chunk:
    """The documents of a chunk in the order of id, with their words and questions."""

    def __init__(self, table: pa.Table, window: int, ranges: int):
        self.table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.window, self.block = window, (window + 1) // 2
        self.ranges = ranges
        self.edges = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)
        hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, texts in slices(self.table.column("text")):
            words = Words(texts, SPACED, fold=False)
            hashes.append(words.hashes)
            counts.append(words.counts)
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        ids = self.table.column("id")
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.asks = (self.counts >= window) & ~np.asarray(ids.is_null())

    def starts(self, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words within a document that takes part."""
        owner = self.owner
        if len(owner) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero((owner[: len(owner) - n + 1] == owner[n - 1 :]) & self.asks[owner[: len(owner) - n + 1]])

    def blocks(self):
        """Starts of the rolling windows, their groups; per group: on the grid, in two documents."""
        at = self.starts(self.block)
        groups = _Grouped(rolling(self.hashes, self.block)[at])
        first = np.cumsum(self.counts) - self.counts
        on_grid = (at - first[self.owner[at]]) % self.block == 0
        grid = groups.per_group(np.maximum, on_grid)
        shared = groups.per_group(np.minimum, self.owner[at]) != groups.per_group(np.maximum, self.owner[at])
        return at, groups, grid, shared

    def passages(self, candidate: np.ndarray):
        """Starts of the candidate passages, their groups, second hashes and smallest owners."""
        at = np.flatnonzero(candidate)
        groups = _Grouped(rolling(self.hashes, self.window)[at])
        second = rolling(mixed(self.hashes ^ np.uint64(0x2545F4914F6CDD1D)), self.window)[at]
        second = (second[groups.order[groups.starts]] >> np.uint64(32)).astype(np.uint32)
        return at, groups, second, groups.per_group(np.minimum, self.owner[at])

    def cuts(self, values: np.ndarray) -> np.ndarray:
        """Where each range of hashes begins in the sorted values, and their end."""
        return np.append(np.searchsorted(values, self.edges), len(values))


def _shift(ranges: int) -> np.uint64:
    return np.uint64(max(0, 33 - ranges.bit_length()))


def _rows(columns: dict[str, list], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))


_ASKED = "place long, chunk long, data binary"
_TYPES = [pa.int64(), pa.int64(), pa.binary()]


def _answers(chunk: _Chunk, values: np.ndarray, rows: dict[int, bytes]) -> np.ndarray:
    """One truth value per group, from the bits of all ranges."""
    out, cuts = np.zeros(len(values), bool), chunk.cuts(values)
    for k in range(chunk.ranges):
        n = cuts[k + 1] - cuts[k]
        if n:
            out[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(rows[k], np.uint8), count=int(n)).astype(bool)
    return out


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Per document row: its id, ``n_words``, ``n_removed``, ``spans`` of the maximal repeats
    (first word, word after the last) and ``kept``, the words left with one space between."""
    if window % 2 == 0:
        raise ValueError("the window is an odd number of words")
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # rows without an id match nothing, and must not meet in one chunk
    lone, given = given.filter("id IS NULL"), given.filter("id IS NOT NULL")
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, ranges = max(1, -(-total // chunk_bytes)), max(1, -(-total // range_bytes))
    shift = _shift(ranges)
    chunked = given.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))

    def ask_blocks(key, table):
        chunk = _Chunk(table, window, ranges)
        _, groups, grid, _ = chunk.blocks()
        cuts, out = chunk.cuts(groups.values), {"place": [], "chunk": [], "data": []}
        for k in range(ranges):
            s, e = cuts[k], cuts[k + 1]
            if e > s:
                short = ((groups.values[s:e] - chunk.edges[k]) >> shift).astype(np.uint32)
                short = np.diff(short, prepend=np.uint32(0))
                out["place"].append(k)
                out["chunk"].append(key[0].as_py())
                out["data"].append(int(e - s).to_bytes(8, "little") + _planes(short) + np.packbits(grid[s:e]).tobytes())
        return _rows(out, _TYPES)

    def find_blocks(key, table):
        """Whether another chunk has the block on its grid."""
        short, grid, sizes = [], [], []
        for data in table.column("data").to_pylist():
            n = int.from_bytes(data[:8], "little")
            view = memoryview(data)[8:]
            short.append(np.cumsum(_unplaned(view, n, np.uint32), dtype=np.uint32))
            grid.append(np.unpackbits(np.frombuffer(view[4 * n :], np.uint8), count=n))
            sizes.append(n)
        groups = _Grouped(np.concatenate(short))
        own = np.concatenate(grid).astype(np.int64)
        found = groups.per_group(np.add, own)[groups.group] > own
        bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
        return _rows({"place": table.column("place").to_pylist(), "chunk": table.column("chunk").to_pylist(), "data": bits}, _TYPES)

    def ask_passages(key, table, answers):
        chunk = _Chunk(table, window, ranges)
        at, groups, grid, shared = chunk.blocks()
        rows = dict(zip(answers.column("place").to_pylist(), answers.column("data").to_pylist(), strict=True))
        hit = (_answers(chunk, groups.values, rows) | (shared & grid))[groups.group]
        sums = np.zeros(len(chunk.hashes) + 1, np.int64)
        sums[at[hit] + 1] = 1
        sums = np.cumsum(sums)
        candidate = np.zeros(len(chunk.hashes), bool)
        passages = chunk.starts(window)
        candidate[passages] = sums[passages + chunk.block] > sums[passages]  # a hit in one of its first windows
        at, groups, second, least = chunk.passages(candidate)
        ids, cuts, own = chunk.ids[least], chunk.cuts(groups.values), key[0].as_py()
        out = {"place": [-1 - own], "chunk": [own], "data": [np.packbits(candidate).tobytes()]}
        for k in range(ranges):
            s, e = cuts[k], cuts[k + 1]
            if e > s:
                out["place"].append(k)
                out["chunk"].append(own)
                out["data"].append(
                    int(e - s).to_bytes(8, "little") + _planes(groups.values[s:e]) + _planes(second[s:e]) + _planes(ids[s:e])
                )
        return _rows(out, _TYPES)

    def find_passages(key, table):
        """Whether a smaller id has the passage; a chunk's candidates go through as they are."""
        if key[0].as_py() < 0:
            return table.select(["place", "chunk", "data"])
        parts, sizes = [], []
        for data in table.column("data").to_pylist():
            n = int.from_bytes(data[:8], "little")
            view = memoryview(data)[8:]
            parts.append((_unplaned(view, n, np.uint64), _unplaned(view[8 * n :], n, np.uint32), _unplaned(view[12 * n :], n, np.int64)))
            sizes.append(n)
        first, second, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((second, first))
        new = np.concatenate(([True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        found = np.empty(len(ids), bool)
        found[order] = least < ids[order]
        bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
        return _rows({"place": table.column("place").to_pylist(), "chunk": table.column("chunk").to_pylist(), "data": bits}, _TYPES)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(key, table, answers):
        chunk = _Chunk(table, window, ranges)
        rows = dict(zip(answers.column("place").to_pylist(), answers.column("data").to_pylist(), strict=True))
        candidate = np.unpackbits(np.frombuffer(rows[-1 - key[0].as_py()], np.uint8), count=len(chunk.hashes)).astype(bool)
        at, groups, _, least = chunk.passages(candidate)
        earlier = _answers(chunk, groups.values, rows)[groups.group]
        earlier |= chunk.ids[chunk.owner[at]] > chunk.ids[least[groups.group]]
        edge = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(edge, at[earlier], 1)
        np.add.at(edge, at[earlier] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(chunk.counts)
        removed = np.bincount(chunk.owner[gone], minlength=len(chunk.counts))
        kept, spans = [], []
        for k, text in enumerate(t for _, some in slices(chunk.table.column("text")) for t in some):
            words = text.split()  # bytes: the same white space
            if removed[k]:
                own = gone[ends[k] - len(words) : ends[k]]
                step = np.diff(own.astype(np.int8), prepend=0, append=0)
                spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)])
                words = [words[i] for i in np.flatnonzero(~own).tolist()]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table(
            [
                chunk.table.column("id"),
                pa.array(chunk.counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, span),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["id", "n_words", "n_removed", "spans", "kept"],
        )

    asked = chunked.groupBy("chunk").applyInArrow(ask_blocks, _ASKED)
    found = asked.groupBy("place").applyInArrow(find_blocks, _ASKED)
    asked = chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(ask_passages, _ASKED)
    found = asked.groupBy("place").applyInArrow(find_passages, _ASKED)
    out = chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        cut, "id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
    )
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    lone = lone.select(
        "id",
        F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start: long, end: long>>").alias("spans"),
        words.alias("kept"),
    )
    return out.unionAll(lone).withColumnRenamed("id", id_col)
