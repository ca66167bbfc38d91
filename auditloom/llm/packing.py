"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document becomes token ids and an end mark; one longer than a sequence is cut into
pieces of full length, the first of which may be shorter. Pieces are then placed, longest
first: each goes where the sum, over the residual gaps, of the squared number of open
sequences with that gap becomes smallest; a new sequence counts as one more place, taken
on a tie only. Only lengths matter for that, so a task holds numbers, never texts.

Pieces are dealt into shards of bounded size by a hash, and each shard is packed by itself.
Sequences that a shard leaves unfilled are opened again: their pieces are dealt anew, into
fewer shards, until one shard holds what is left, so the waste stays that of one shard.

Tokenising: texts are cut before each single space between two characters that are not
white space. The tokenizer's own rule always starts a new token there, so the parts can be
looked up one by one; each different part is tokenised once per task.

Edge cases: a null or empty text is the end mark alone; repeated rows are packed as often
as they stand; pieces of equal length are placed in the order of id and piece; other
columns are ignored; a null id is kept; texts of any length are taken whole; no rows give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.shared import settled
from auditloom.llm.words import BLOCK, Words, groups, slices

CAPACITY = 2048
END = 0
SHARD_PIECES = 50_000
_KEPT_IDS = 4_000_000
_JOINED = 5_000

#: Fixed value: how byte-level tokenizers of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: ASCII white space and separators.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True

#: First bytes of the UTF-8 of all other white space.
_BLANK_LEAD = np.zeros(256, dtype=bool)
_BLANK_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Tokens:
    """Token ids of texts, equal to the tokenizer's, with each different part tokenised once."""

    def __init__(self, path: str, marked: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder() if marked else None
        self.added = _Added(added) if added else None
        self.tokenizer.encode_special_tokens = True
        model = json.loads(self.tokenizer.to_str())
        vocabulary = model["model"]["vocab"]
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():  # one character of a token's name is one byte
            self.sizes[k] = len(token)
        self.quick = _rank_encoder(model)
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.quick:
            return [np.array(self.quick.encode_ordinary(t), np.uint32) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, place: np.ndarray, hashes: np.ndarray, parts: list[bytes], inner: np.ndarray) -> None:
        """Parts between two cuts are tokenised end to end, and told apart by their bytes."""
        counts, ids = np.empty(len(parts), np.int64), []
        whole, edge = np.flatnonzero(inner), np.flatnonzero(~inner)
        for at in range(0, len(whole), _JOINED):
            some = whole[at : at + _JOINED]
            (found,) = self._encode([b"".join(parts[i] for i in some).decode()])
            ends = np.cumsum(np.fromiter((len(parts[i]) for i in some), np.int64, len(some)))
            counts[some] = np.diff(np.searchsorted(np.cumsum(self.sizes[found]), ends), prepend=-1)
            ids.append(found)
        alone = self._encode([parts[i].decode() for i in edge])
        counts[edge] = [len(x) for x in alone]
        order = np.concatenate([whole, edge])
        starts = np.empty(len(parts), np.int64)
        starts[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *ids, *alone])
        self.known = np.insert(self.known, place, hashes)
        self.starts, self.counts = np.insert(self.starts, place, starts), np.insert(self.counts, place, counts)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        if self.added and self.added.any(texts):
            return self._split(texts)
        return self._of(texts)

    def _of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > _KEPT_IDS:  # a long part counts by its ids
            self.clear()
        parts = _Parts(texts)
        hashes, first, which = np.unique(parts.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.known))
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            inner = np.ones(len(parts.starts), bool)
            some = parts.counts > 0
            inner[parts.bounds[:-1][some]] = inner[parts.bounds[1:][some] - 1] = False
            self._learn(at[new], hashes[new], [parts.word(i) for i in first[new]], inner[first[new]])
            at = np.searchsorted(self.known, hashes)
        counts, starts = self.counts[at][which], self.starts[at][which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(starts - (ends - counts), counts)]
        return ids, np.diff(np.concatenate(([0], ends))[parts.bounds])


    def _split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``of``, with texts cut at added tokens, whose ids stand between the parts."""
        parts, marks, owner = [], [], []
        for k, text in enumerate(texts):
            for part, mark in self.added.parts(text):
                parts.append(part)
                marks.append(mark)
                owner.append(k)
        ids, counts = self._of(parts)
        marks, owner = np.array(marks, np.int64), np.array(owner)
        after = marks >= 0
        ids = np.insert(ids, np.cumsum(counts)[after], marks[after].astype(np.uint32))
        return ids, np.bincount(owner, weights=counts + after, minlength=len(texts)).astype(np.int64)


class _Added:
    """Where a text holds added tokens, as the unmodified tokenizer cuts it."""

    def __init__(self, tokens: dict):
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens.values()):
            raise ValueError("added tokens that take in blanks or need whole words are not supported")
        self.ids = {t.content.encode(): k for k, t in tokens.items()}
        self.rule = re.compile(b"|".join(re.escape(n) for n in sorted(self.ids, key=len, reverse=True)))

    def any(self, texts: list[bytes]) -> bool:
        return any(name in text for name in self.ids for text in texts)

    def parts(self, text: bytes):
        """Each part with the id of the token after it, -1 after the last."""
        at = 0
        for m in self.rule.finditer(text):
            yield text[at : m.start()], self.ids[m.group()]
            at = m.end()
        yield text[at:], -1


def _rank_encoder(model: dict):
    """The same vocabulary and merges in a quicker encoder, where ids grow in merge order."""
    import tiktoken

    vocabulary = model["model"]["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["model"]["merges"]]
    ranks = [vocabulary[m] for m in merged]
    rule = model["pre_tokenizer"]
    if ranks != sorted(ranks) or rule["type"] != "ByteLevel" or not rule["use_regex"] or rule["add_prefix_space"] or model["normalizer"]:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    known = {bytes(names[c] for c in token): k for token, k in vocabulary.items() if all(c in names for c in token)}
    special = {t["content"].encode() for t in model["added_tokens"]}
    return tiktoken.Encoding(
        "ranks", pat_str=PATTERN, mergeable_ranks={t: k for t, k in known.items() if t not in special}, special_tokens={}
    )


class _Parts(Words):
    """Texts cut before single spaces, each part as one 'word' with its leading space."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join([*texts, b""])
        self.data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        first = self.text_starts[:-1][lengths > 0]
        last = (self.text_starts[:-1] + lengths)[lengths > 0]
        d = self.data
        if len(d) > 4:
            i = np.flatnonzero(d[3:-1] == 32) + 3
            before, after = d[i - 1], d[i + 1]
            # beyond ASCII, characters of the blocks that hold white space are left uncut
            ok = ~_BLANK[before] & ~_BLANK[after] & ~_BLANK_LEAD[after]
            ok &= (before < 128) | ~(_BLANK_LEAD[d[i - 2]] | ((d[i - 2] >= 128) & _BLANK_LEAD[d[i - 3]]))
            cut = i[ok]
        else:
            cut = first[:0]
        self.starts = np.sort(np.concatenate([first, cut]))
        self.ends = np.sort(np.concatenate([last, cut]))
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)
        self.hashes = self._hashes()


@cache
def tokens(path: str, marked: bool = False) -> Tokens:
    return Tokens(path, marked)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, marked: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``ids`` on demand.

    ``marked``: the text of an added token (``<|endoftext|>``) is that token, as the tokenizer
    does unless told otherwise; else its characters are taken as any others.
    """

    def run(batches):
        table = tokens(tokenizer, marked)
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 * BLOCK):
                ids, counts = table.of(texts)
                ends = np.cumsum(counts)
                rows: list[tuple] = []
                for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    own = np.append(ids[end - n : end], np.uint32(END)).astype("<u4")
                    start, size = 0, len(own) % capacity or capacity
                    for piece in range(-(-len(own) // capacity)):
                        part = own[start : start + size]
                        rows.append((k, piece, start, size, zlib.crc32(part.tobytes()), part if with_ids else None))
                        start, size = start + size, capacity
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([at + r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int32()),
                        *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)),
                        *([pa.array([r[5] for r in rows], pa.list_(pa.int64()))] if with_ids else []),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = ", ids array<long>" if with_ids else ""
    return given.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long{ids}").withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece; ``lengths`` are taken in the given order."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by gap
    placed, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # the change of the sum when a gap of g becomes one of g - size
        change = 2 * (counts[0 : capacity + 1 - size] - counts[size:])
        change += 2
        change[0] = 1 - 2 * counts[size]  # a filled sequence is open no more
        if size:
            change[counts[size:] == 0] = far
        best = int(change.argmin())
        fresh = 2 * int(counts[capacity - size]) + 1 if size < capacity else 0
        if change[best] <= fresh:
            gap = best + size
            sequence = open_at[gap].pop()
            counts[gap] -= 1
        else:
            sequence, gap, made = made, capacity, made + 1
        placed[i], offset[i] = sequence, capacity - gap
        left = gap - size
        if left:
            counts[left] += 1
            open_at[left].append(sequence)
    return placed, offset


def _placed(todo: DataFrame, level: int, shards: int, capacity: int, id_col: str) -> DataFrame:
    """The pieces with sequence, offset and the gap their sequence is left with."""
    fields = [f for f in todo.schema.fields if f.name not in ("sequence_id", "offset", "gap")]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "gap"))])
    names = [f.name for f in fields]

    def run(batches):
        for table in groups(batches, "__shard"):
            lengths = np.asarray(table.column("length"))
            sequence, offset = sum_of_squares(lengths, capacity)
            gaps = capacity - np.bincount(sequence, weights=lengths).astype(np.int64)
            sequence_id = (level << 54) + (table.column("__shard")[0].as_py() << 28) + sequence
            columns = [table.column(c).combine_chunks() for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence_id), pa.array(offset), pa.array(gaps[sequence])], schema.names
            )

    dealt = todo.select(*names, F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(shards)).alias("__shard"))
    dealt = dealt.repartition("__shard").sortWithinPartitions("__shard", F.desc("length"), id_col, "piece")
    return dealt.mapInArrow(run, schema)


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    marked: bool = False,
) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``, the piece's place in it."""
    todo = settled(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids, marked))
    shards, level, done = max(1, -(-todo.count() // shard_pieces)), 0, []
    while True:
        placed = settled(_placed(todo, level, shards, capacity, id_col))
        opened = placed.filter("gap > 0")
        fewer = max(1, -(-opened.count() // shard_pieces)) if shards > 1 else shards
        if fewer >= shards:
            done.append(placed)
            break
        done.append(placed.filter("gap = 0"))
        todo, shards, level = opened, fewer, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("gap")


def sequences(pieces_packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order, from rows packed ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces_packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
