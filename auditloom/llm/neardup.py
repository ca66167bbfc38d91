"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the hashes of its distinct word shingles. One permutation scatters
a shingle over 2**32 places; a second one, shifted circularly by k, gives coordinate k of
the signature as the smallest place in the set: two permutations make all coordinates.
Documents that agree on all rows of a band become candidates; candidate groups are then
compared on full sets, so a reported link is exact. At a similarity of 0.8, 32 bands of 4
rows miss a pair with a probability below 1e-7.

Groups of copies stay cheap: equal sets are one representative before banding; a bucket is
its members' links to the smallest one, found with map-side minima; candidate groups are
compared in blocks of bounded size, where each task walks from document to document and
emits only the links that join new ones, never all pairs.

Edge cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words
than a shingle is one shingle; a null or empty text has an empty set, is linked with
nothing and is kept; rows repeated with the same id are one document; a row with a null id
is linked with nothing, its component is null and it is kept; texts of any length
are taken whole; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.shared import components, settled
from auditloom.llm.words import SPACED, Words, groups, mixed, rolling, slices

BANDS, ROWS = 32, 4
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and their counts."""
    words = Words(texts, SPACED, fold=True)
    text_of = words.text_of_words()
    hashes = rolling(words.hashes, n)
    at = np.flatnonzero(text_of[: len(hashes)] == text_of[n - 1 :]) if len(hashes) else np.empty(0, np.int64)
    hashes, owner = hashes[at], text_of[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = [rolling(words.hashes[words.bounds[k] : words.bounds[k + 1]], int(words.counts[k])) for k in short]
        hashes, owner = np.concatenate([hashes, *whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner = hashes[new], owner[new]
    return hashes, np.bincount(owner, minlength=len(texts))


def signature(hashes: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` circulant MinHash coordinates of each non-empty set, one row per coordinate."""
    starts = np.cumsum(counts) - counts
    starts = starts[counts > 0]
    out = np.empty((size, len(starts)), np.uint32)
    if not len(starts):
        return out
    place = (mixed(hashes + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(size):
        np.subtract(place, np.uint32(k), out=x)  # the second permutation, shifted by k
        np.right_shift(x, 16, out=y)
        x ^= y
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, 13, out=y)
        x ^= y
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, 16, out=y)
        x ^= y
        out[k] = np.minimum.reduceat(x, starts)
    return out


def _sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Id, set size, two set fingerprints and the band keys (none for an empty set)."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                hashes, counts = shingle_sets(texts, n)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                prints = np.zeros((2, len(texts)), np.uint64)
                if len(some):
                    for row, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
                        prints[row, some] = np.add.reduceat(mixed(hashes ^ np.uint64(salt)), starts)
                coordinates = signature(hashes, counts).astype(np.uint64)
                keys = np.empty((len(some), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(some), b, np.uint64)
                    for r in range(ROWS):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + coordinates[b * ROWS + r])
                    keys[:, b] = key
                ends = np.concatenate(([0], np.cumsum((counts > 0) * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["id", "n_shingles", "print_a", "print_b", "bands"],
                )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("print_a", T.LongType()),
            T.StructField("print_b", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, schema)


def _walk(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the linked sets, each found by comparing full sets."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * shared >= percent * (sizes.sum() - shared) else []
    all_hashes, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(all_hashes), bool)
    starts = np.cumsum(sizes) - sizes
    rest, rest_codes, rest_starts = np.arange(len(sets)), codes, starts
    free = np.ones(len(sets), bool)
    found = []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed], queue = False, [seed]
        while queue:
            u = queue.pop()
            if 2 * free[rest].sum() < len(rest):  # leave out what is settled
                rest = rest[free[rest]]
                if not len(rest):
                    return found
                rest_codes = np.concatenate([codes[starts[i] : starts[i] + sizes[i]] for i in rest])
                rest_starts = np.cumsum(sizes[rest]) - sizes[rest]
            own = codes[starts[u] : starts[u] + sizes[u]]
            marked[own] = True
            shared = np.add.reduceat(marked[rest_codes], rest_starts, dtype=np.int64)
            marked[own] = False
            linked = rest[(100 * shared >= percent * (sizes[u] + sizes[rest] - shared)) & free[rest]]
            free[linked] = False
            queue += linked.tolist()
            found += [(u, int(v)) for v in linked]
    return found


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document row: its id, ``n_shingles``, ``component_id`` (the smallest id it is
    linked with, however far) and ``kept`` (it is that id). Two documents are linked if
    ``percent`` of the union of their shingle sets, or more, is shared.
    """
    sketches = settled(_sketches(docs, shingle, id_col, text_col))
    filled = sketches.filter("n_shingles > 0 AND id IS NOT NULL")
    same = filled.groupBy("print_a", "print_b").agg(F.min("id").alias("first"))
    filled = filled.join(same, ["print_a", "print_b"])

    banded = filled.filter("id = first").select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("c")).filter("b < c")
    candidates = banded.join(buckets, "band").filter("id > b").select(F.col("id").alias("a"), "b").distinct()
    rough = components(candidates)
    rough = rough.unionAll(rough.select("component", "component").distinct())

    sizes = sketches.select(F.col("id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("size"))
    rough = settled(rough.join(sizes, "node"))
    blocks = rough.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own"))))
    placed = rough.join(blocks, "component").withColumn("own", own)
    texts = docs.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pairs = (
        texts.join(placed, "node")
        .select("node", "text", "component", "own", other.alias("other"))
        .select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "node", "text")
    )

    def compare(batches):
        for table in groups(batches, "pair"):
            nodes = table.column("node")
            sets: list[np.ndarray] = []
            for _, some in slices(table.column("text")):
                hashes, counts = shingle_sets(some, shingle)
                sets += np.split(hashes, np.cumsum(counts)[:-1])
            a, b = zip(*found, strict=True) if (found := _walk(sets, percent) if len(sets) > 1 else []) else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.take(pa.array(x, pa.int64())).to_pylist(), nodes.type) for x in (a, b)], ["a", "b"]
            )

    id_type = docs.schema[id_col].dataType
    links = pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(
        compare, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    )
    linked = components(links)
    firsts = same.join(linked, F.col("first") == F.col("node"), "left").select(
        "print_a", "print_b", F.coalesce("component", "first").alias("component_id")
    )
    whole = sketches.select("id", "n_shingles", "print_a", "print_b")
    some = whole.filter("n_shingles > 0 AND id IS NOT NULL").join(firsts, ["print_a", "print_b"])
    none = whole.filter("n_shingles = 0 OR id IS NULL").withColumn("component_id", F.col("id"))
    return some.unionByName(none).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
