"""Two tokenizers' tokens of the same texts, linked where their bytes overlap.

The tokens of a slice of texts lie on one line of bytes, and each tokenizer gives a sorted
list of token ends. Merging both lists is cut into pieces of equal work: a binary search on
the merge's diagonal finds for every piece how many ends of each list come before it, so
pieces are independent however unequal the texts are. A piece emits, for each different end
in it, the token of A and the token of B that cover the bytes before that end: one link. An
end that both lists have closes a group; where the two equal ends fall into different pieces,
the stitching drops the second one and closes the group.

How often a pair of ids is linked is counted over all texts: per slice, per task, then by
pair. To look these counts up, pairs that hold at least ``1 / KNOWN`` of all links are
broadcast, of which there are at most ``KNOWN``; the links of rarer pairs, which no pair has
many of, are joined in a shuffle.

B's tokens are found part by part: texts are cut before each space after another character,
where no token of B can reach across, and each different short part is encoded once.

Edge cases: a text that is null, empty, or that B does not give back byte for byte (it holds
U+2581, say) has no tokens, zeros and an empty list of groups; repeated rows count as often
as they stand; other columns are ignored; texts of any length are taken whole; no rows give
none. B's pieces must not hold a space after another character (checked when it is loaded).
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.packing import Tokens
from auditloom.llm.words import BLOCK, Words, slices
from auditloom.session import settled

PIECE = 1 << 16
KNOWN = 1 << 20
_KEPT_IDS = 4_000_000
_SHORT = 64
_SIDE = 32  # bits of B's id in a pair

#: Bytes that stand for themselves in the vocabulary of a byte-level tokenizer.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Vocabulary:
    """The bytes of each token."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


class ByteTokens:
    """Ids of a byte-level tokenizer; its special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.tokens = Tokens(path)
        names = {chr(b): b for b in PLAIN_BYTES}
        names |= {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*PLAIN_BYTES}))}
        given = self.tokens.tokenizer.get_vocab()
        table = [b""] * (max(given.values()) + 1)
        for token, k in given.items():
            table[k] = bytes(names[c] for c in token if c in names)
        self.vocabulary = Vocabulary(table)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.tokens.of(texts)


class PieceTokens:
    """Ids of a piece tokenizer with byte fallback; texts are given with the space it adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("pieces that hold a space after another character are not supported")
        self.vocabulary = Vocabulary(
            [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        )
        self.space = self.model.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that each begin with the space the model adds."""
        found = self.model.encode([p[1:].decode() for p in parts], num_threads=1)
        found = [ids or [self.space] * (len(p) == 1) for ids, p in zip(found, parts, strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((k for ids in found for k in ids), np.uint32, int(counts.sum())), counts

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > _KEPT_IDS:
            self.clear()
        parts = _SpacedParts(texts)
        hashes, first, which = np.unique(parts.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        old = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.known))
        old[inside] = self.known[at[inside]] == hashes[inside]
        new = np.flatnonzero(~old)
        found, sizes = self.encode([parts.word(i) for i in first[new]])
        starts, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        starts[old], counts[old] = self.starts[at[old]], self.counts[at[old]]
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        starts[new], counts[new] = begins, sizes
        table = np.concatenate([self.ids, found])
        counts, starts = counts[which], starts[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.arange(total) + np.repeat(starts - (ends - counts), counts)]
        # long parts are not kept, or texts without spaces would fill the table
        short = (parts.ends - parts.starts)[first[new]] <= _SHORT
        kept, place = new[short], at[new[short]]
        self.ids = np.concatenate([self.ids, found[np.repeat(short, sizes)]])
        self.known = np.insert(self.known, place, hashes[kept])
        self.starts = np.insert(self.starts, place, len(self.ids) - int(sizes[short].sum()) + np.cumsum(sizes[short]) - sizes[short])
        self.counts = np.insert(self.counts, place, sizes[short])
        return ids, np.diff(np.concatenate(([0], ends))[parts.bounds])


class _SpacedParts(Words):
    """Texts cut before each space that follows another character."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        some = lengths > 0
        first, last = self.text_starts[:-1][some], (self.text_starts[:-1] + lengths)[some]
        cut = np.flatnonzero((self.data[1:] == 32) & (self.data[:-1] != 32)) + 1
        cut = cut[~np.isin(cut, first)]
        self.starts, self.ends = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)
        self.hashes = self._hashes()


@cache
def _loaded(kind: type, path: str):
    return kind(path)


def diagonals(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before each piece of ``size`` merged ends, ``a`` first on ties.

    All diagonals are searched at once, in as many steps as one takes.
    """
    k = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, k - len(b)), np.minimum(k, len(a))
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low, k - low
        middle = (low[todo] + high[todo]) // 2
        more = a[middle] <= b[k[todo] - middle - 1]
        low[todo[more]] = middle[more] + 1
        high[todo[~more]] = middle[~more]


def overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A piece: its different ends, the tokens of A and B before each end, and whether both end there.

    ``i`` and ``j`` are the numbers of the first tokens of ``a`` and ``b``.
    """
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    ends = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    left, right = np.searchsorted(a, ends), np.searchsorted(b, ends)
    closes = np.searchsorted(a, ends, side="right") - left + np.searchsorted(b, ends, side="right") - right == 2
    return ends, left + i, right + j, closes


def aligned(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links between the tokens that end at ``a`` and at ``b``, and after which links a group ends."""
    left, right = diagonals(a, b, size)
    pieces = [
        overlaps(a[i:k], b[j:m], i, j) for i, k, j, m in zip(left[:-1], left[1:], right[:-1], right[1:], strict=True)
    ]
    for before, piece in zip(pieces[:-1], pieces[1:], strict=True):
        if len(before[0]) and len(piece[0]) and before[0][-1] == piece[0][0]:  # A's end there, B's equal one here
            before[3][-1] = True
            piece[3][0] = False
    out: list[list[np.ndarray]] = [[], [], []]
    for k, (ends, at_a, at_b, closes) in enumerate(pieces):
        seen = slice(1, None) if k and len(ends) and len(pieces[k - 1][0]) and pieces[k - 1][0][-1] == ends[0] else slice(None)
        for column, values in zip(out, (at_a, at_b, closes), strict=True):
            column.append(values[seen])
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


def _numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to size - 1, left-aligned, and how many there are."""
    digits = len(str(max(size - 1, 1)))
    names = np.array([str(k) for k in range(size)], f"S{digits + 1}")
    return names.view(np.uint8).reshape(size, digits + 1), np.char.str_len(names)


class Aligner:
    """Both tokenizers, and what a slice of texts gives."""

    def __init__(self, a_path: str, b_path: str, piece: int):
        self.a, self.b, self.piece = _loaded(ByteTokens, a_path), _loaded(PieceTokens, b_path), piece
        self.names = _numerals(max(len(self.a.vocabulary.sizes), len(self.b.vocabulary.sizes)))

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both: all ids, and how many each text has; none where the bytes differ."""
        lines = [b" " + t if t else b"" for t in texts]
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        found, whole = [], np.ones(len(lines), bool)
        for side in (self.a, self.b):
            ids, counts = side.of(lines)
            at = np.concatenate(([0], np.cumsum(counts)))
            got = np.concatenate(([0], np.cumsum(side.vocabulary.sizes[ids])))[at]
            joined, want = side.vocabulary.joined(ids), np.frombuffer(b"".join(lines), np.uint8)
            if len(joined) != len(want) or not np.array_equal(joined, want):
                begins = np.cumsum(lengths) - lengths
                for k in range(len(lines)):
                    own, line = joined[got[k] : got[k + 1]], want[begins[k] : begins[k] + lengths[k]]
                    whole[k] &= np.array_equal(own, line)
            found.append((ids, counts))
        if whole.all():
            return found
        return [(ids[np.repeat(whole, counts)], np.where(whole, counts, 0)) for ids, counts in found]

    def run(self, texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Counts per text; the different pairs of each text (text, pair, links); the groups as text."""
        (a_ids, n_a), (b_ids, n_b) = self.tokens(texts)
        a_ends, b_ends = np.cumsum(self.a.vocabulary.sizes[a_ids]), np.cumsum(self.b.vocabulary.sizes[b_ids])
        at_a, at_b, closes = aligned(a_ends, b_ends, self.piece)
        a_text = np.repeat(np.arange(len(texts)), n_a)
        text = a_text[at_a]
        counts = {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(text[closes], minlength=len(texts)),
            "n_links": np.bincount(text, minlength=len(texts)),
        }
        links = (a_ids[at_a].astype(np.int64) << _SIDE) | b_ids[at_b].astype(np.int64)
        order = np.lexsort((links, text))
        links, text = links[order], text[order]
        new = np.append(True, (links[1:] != links[:-1]) | (text[1:] != text[:-1])) if len(links) else np.empty(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(links)))
        return counts, text[at], links[at], times, self._groups(a_ids, b_ids, n_a, n_b, at_a[closes], at_b[closes])

    def _groups(self, a_ids, b_ids, n_a, n_b, last_a, last_b) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``; the last token of each group in A and in B is given."""
        digits, sizes = self.names
        ids = np.concatenate([a_ids, b_ids]).astype(np.int64)
        group_a = np.searchsorted(last_a, np.arange(len(a_ids)))
        group_b = np.searchsorted(last_b, np.arange(len(b_ids)))
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[last_a] = ord("|")
        mark[len(a_ids) + last_b] = ord(";")
        place = np.empty(len(ids), np.int64)  # all of a group's A before its B
        place[: len(a_ids)] = np.arange(len(a_ids)) + np.concatenate(([0], last_b + 1))[group_a]
        place[len(a_ids) :] = np.arange(len(b_ids)) + (last_a + 1)[group_b]
        order = np.empty(len(ids), np.int64)
        order[place] = np.arange(len(ids))
        ids, mark = ids[order], mark[order]
        cells, used = digits[ids].copy(), sizes[ids]
        cells[np.arange(len(ids)), used] = mark
        data = cells[np.arange(cells.shape[1]) <= used[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(used + 1)))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        return [
            hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        ]


@cache
def _aligner(a_path: str, b_path: str, piece: int) -> Aligner:
    return Aligner(a_path, b_path, piece)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def links(
    docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and its different ``pairs``.

    A pair is A's id times 2**32 plus B's id; ``times`` has how many links of the document hold it.
    """

    def run(batches):
        aligner = _aligner(a_path, b_path, piece)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                counts, owner, pairs, times, groups = aligner.run(texts)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        *(pa.array(counts[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")),
                        pa.array(groups, pa.string()),
                        _lists(pairs, bounds, pa.int64()),
                        _lists(times, bounds, pa.int64()),
                    ],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = given.mapInArrow(
        run,
        f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>",
    )
    return found.withColumnRenamed("id", id_col)


def pair_counts(linked: DataFrame) -> DataFrame:
    """Over all documents: ``a_id``, ``b_id``, ``n_links``, and whether no other pair of that B has more (``best``)."""
    return _counted(linked).select(
        F.shiftright("pair", _SIDE).alias("a_id"), F.col("b").alias("b_id"), F.col("n").alias("n_links"), "best"
    )


def _counted(linked: DataFrame) -> DataFrame:
    def run(batches):
        held = [np.empty((2, 0), np.int64)]
        for batch in batches:
            pairs, times = (np.asarray(batch.column(c).flatten()) for c in ("pairs", "times"))
            held.append(np.stack([pairs, times]))
            if sum(h.shape[1] for h in held) > _KEPT_IDS:
                held = [_summed(held)]
                if held[0].shape[1] > _KEPT_IDS // 2:
                    yield from _rows(held.pop())
        if held:
            yield from _rows(_summed(held))

    def _rows(found):
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["pair", "n"])

    each = linked.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    each = settled(each.withColumn("b", F.col("pair").bitwiseAND((1 << _SIDE) - 1)))
    most = each.groupBy("b").agg(F.max("n").alias("most"))  # no more rows than B has ids
    return each.join(F.broadcast(most), "b").select("pair", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(held: list[np.ndarray]) -> np.ndarray:
    pairs, times = np.concatenate(held, axis=1)
    different, which = np.unique(pairs, return_inverse=True)
    return np.stack([different, np.bincount(which, weights=times, minlength=len(different)).astype(np.int64)])


def alignments(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    piece: int = PIECE,
    known: int = KNOWN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The counts of ``links`` per document, and what all documents say of its links.

    ``n_best``: links whose pair is, over all documents, the most frequent of its B id (ties
    included); ``count_sum``: the sum, over its links, of how often the pair is linked anywhere.
    """
    spark = docs.sparkSession
    linked = settled(links(docs, a_path, b_path, piece, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()))
    counted = settled(_counted(linked))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # pairs of at least total / known links: at most known of them
    common = counted.filter(F.col("n") >= F.lit(-(-total // known))).select("pair", "n", "best").toArrow()
    common = common.sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(np.asarray(common[c].combine_chunks()) for c in ("pair", "n")) + (np.array(common["best"].to_pylist(), bool),))

    def run(batches):
        pair, n, best = table.value
        for batch in batches:
            pairs, times = (np.asarray(batch.column(c).flatten()) for c in ("pairs", "times"))
            lengths = np.asarray(pc.list_value_length(batch.column("pairs"))).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            found = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at = at[found]
            own, rest = (np.searchsorted(owner[some], np.arange(len(lengths) + 1)) for some in (found, ~found))
            sums = [np.diff(np.append(0, np.cumsum(w))[own]) for w in (times[found] * best[at], times[found] * n[at])]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, sums), _lists(pairs[~found], rest, pa.int64()), _lists(times[~found], rest, pa.int64())],
                [*kept, "n_best", "count_sum", "pairs", "times"],
            )

    kept = [c for c in linked.columns if c not in ("pairs", "times")]
    id_type = docs.schema[id_col].dataType.simpleString()
    types = {id_col: id_type, "groups_sha256": "string"}
    schema = ", ".join(f"`{c}` {types.get(c, 'long')}" for c in kept)
    seen = linked.mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<long>, times array<long>")
    seen = settled(seen)
    rare = seen.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "__row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    rare = rare.join(counted.filter(F.col("n") < F.lit(-(-total // known))), "pair")
    more = rare.select(
        *(F.lit(None).cast(types.get(c, "long")).alias(c) if c != "__row" else F.col(c) for c in kept),
        F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).cast("long").alias("n_best"),
        (F.col("times") * F.col("n")).alias("count_sum"),
    )
    both = seen.select(*kept, "n_best", "count_sum").unionAll(more)
    values = [F.any_value(F.col(f"`{c}`"), True).alias(c) for c in kept if c != "__row"]
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return both.groupBy("__row").agg(*values, *sums).drop("__row")
