"""The prefix tree of conversations, with prefixes that only one conversation has kept out of the shuffle.

A prefix is known by a 120-bit digest: the exclusive or, over its turns, of a hash of each
turn and its position. Digests of running prefixes are thus running totals, and a conversation
of any length is cut into blocks of positions whose totals are added up; to number its turns
in the first place, rows are dealt into ranges of (conversation, turn).

A count-min sketch counts all prefixes: two rows of cells that stop at 2, added up over the
tasks in segments. An estimate is never too low, so an estimate of one proves that no other
conversation has the prefix. Such prefixes, the tails, become nodes where they stand. Only
prefixes with a higher estimate are shuffled and grouped by their digest, which is exact, so
the sketch's size (at most ``MOST_CELLS`` a row) decides how much is shuffled, never the result.

What concerns subtrees needs no walk from level to level. A node belongs to its smallest
member; the nodes a conversation owns are its path from some depth on. So a sum over
different nodes is a sum over members: of a node's members, those that own a childless node
are its leaves, and a member adds to the saving the bytes of its path from that node down to
where its own nodes begin.

Edge cases: rows without a conversation id are left out; a null role or text is empty; a null
turn comes first, and turns of equal number are in the order of a digest of role and text, so
equal rows follow each other; a conversation of any length is taken whole; one whose turns
all fall away is a member of the root; other columns are ignored; no rows give no nodes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.ordered import in_ranges
from auditloom.session import settled

BLOCK = 4096  # positions
MOST_CELLS = 1 << 24
_SEGMENT = 1 << 16
_CHUNK = 1 << 17
_HEAVY = 10_000
_U = np.uint64


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 1, by turn), a digest of role and text, and the ``size`` of the text in bytes."""
    role_text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    given = rows.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.md5(F.concat(F.octet_length(role_text[0]).cast("string"), F.lit(":"), *role_text)).alias("digest"),
        F.octet_length(role_text[1]).cast("long").alias("size"),
    )
    dealt, _ = in_ranges(given, ["conv", "turn", "digest"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_part = Window.partitionBy("__part", "conv")
    numbered = dealt.withColumn("pos", F.row_number().over(in_part.orderBy("turn", "digest")).cast("long"))
    numbered = settled(numbered.select("conv", "pos", "digest", "size", "__part"))
    # a conversation has one row here for each range that it spans
    parts = numbered.groupBy("conv", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.sum("n").over(before)).filter("before > 0").select("conv", "__part", "before")
    out = numbered.join(parts, ["conv", "__part"], "left")
    return out.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "size")


def shared_heads(given: DataFrame, heads: Column, most: int, family: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first conversation.

    Of conversation c the first h turns (``heads``, a function of ``conv``, at most ``most``)
    are replaced by as many of conversation c - c % family. Returns the turns and, for each
    conversation, ``conv`` and ``len``.
    """
    base = F.col("conv") - F.col("conv") % family
    known = given.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", heads.alias("h"), base.alias("base"))
    known = settled(known)
    lengths = known.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = known.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = settled(known.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    block = F.floor(F.col("pos") / BLOCK)
    spread = known.filter("n > h").select("conv", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
    own = given.withColumn("block", block).join(spread, ["conv", "block"]).filter("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size")
    first = given.filter((F.col("pos") <= most) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    copied = first.join(known.filter("taken > 0").select("conv", "base", "taken"), "base").filter("pos <= taken")
    return own.unionAll(copied.select("conv", "pos", "digest", "size")), known.select("conv", "len")


def prefixes(given: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth, the root included.

    ``d1``, ``d2``: the digest of the prefix; ``p1``, ``p2``: of the one before; ``size``:
    bytes of the last text; ``before``: bytes of the texts before it; ``last``: the
    conversation ends here.
    """
    place = F.concat_ws(":", F.col("pos").cast("string"), "digest")
    turn = [F.conv(F.substring(F.md5(place), s, 15), 16, 10).cast("long") for s in (1, 17)]
    rows = given.select("conv", "pos", "size", turn[0].alias("t1"), turn[1].alias("t2"))
    rows = rows.unionAll(convs.select("conv", *(F.lit(0).cast("long").alias(c) for c in ("pos", "size", "t1", "t2"))))
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    sums = lambda w: [F.bit_xor("t1").over(w).alias("d1"), F.bit_xor("t2").over(w).alias("d2"), F.sum("size").over(w).alias("upto")]
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = settled(rows.select("*", *sums(inside)))
    totals = rows.groupBy("conv", "block").agg(*(f.alias(c) for f, c in ((F.bit_xor("t1"), "t1"), (F.bit_xor("t2"), "t2"), (F.sum("size"), "size"))), F.max("pos").alias("far"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.partitionBy("conv")
    totals = totals.select("conv", "block", *(x.alias(f"o_{n}") for x, n in zip(sums(earlier), ("d1", "d2", "upto"), strict=True)), F.max("far").over(ends).alias("len"))
    out = rows.join(totals, ["conv", "block"])
    add = lambda c: F.coalesce(f"o_{c}", F.lit(0))
    d1, d2 = (F.col(c).bitwiseXOR(add(c)) for c in ("d1", "d2"))
    return out.select(
        "conv",
        F.col("pos").alias("depth"),
        d1.alias("d1"),
        d2.alias("d2"),
        d1.bitwiseXOR(F.col("t1")).alias("p1"),
        d2.bitwiseXOR(F.col("t2")).alias("p2"),
        "size",
        (F.col("upto") + add("upto") - F.col("size")).alias("before"),
        (F.col("pos") == F.col("len")).alias("last"),
    )


class Sketch:
    """Two rows of count-min cells that stop at 2."""

    def __init__(self, cells: int):
        self.size, self.cells = cells, np.zeros(2 * cells, np.uint8)

    def places(self, d1: np.ndarray, d2: np.ndarray) -> list[np.ndarray]:
        """Digests are even already: the low bits of each half choose a cell of a row."""
        mask = self.size - 1
        return [d1 & mask, (d2 & mask) + self.size]

    def add(self, d1: np.ndarray, d2: np.ndarray) -> None:
        for at in self.places(d1, d2):
            cells, times = np.unique(at, return_counts=True)
            self.cells[cells] = np.minimum(self.cells[cells] + np.minimum(times, 2), 2)

    def single(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Where the estimate, the smaller cell, is one."""
        a, b = self.places(d1, d2)
        return np.minimum(self.cells[a], self.cells[b]) == 1


def sketch(found: DataFrame, most: int = MOST_CELLS) -> Sketch:
    """The sketch of all prefixes, with two cells or more for each as far as ``most`` allows."""
    cells = 1 << min(most.bit_length() - 1, max(12, (2 * found.count()).bit_length()))
    width = min(_SEGMENT, cells)

    def count(batches):
        own = Sketch(cells)
        for batch in batches:
            own.add(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        parts = own.cells.reshape(-1, width)
        some = np.flatnonzero(parts.any(axis=1))
        packed = [zlib.compress(parts[k].tobytes(), 1) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed, pa.binary())], ["segment", "cells"])

    def add(batches):
        at, total = None, None
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(zlib.decompress(packed), np.uint8)
                if k != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = k, np.zeros(width, np.uint8)
                total = np.minimum(total + cells, 2).astype(np.uint8)
        if at is not None:
            yield row(at, total)

    def row(k, total):
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["segment", "cells"])

    schema = "segment long, cells binary"
    merged = found.select("d1", "d2").mapInArrow(count, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(add, schema)
    out = Sketch(cells)
    for r in merged.collect():  # two bytes a cell pair, most cells at the most
        out.cells[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
    return out


def screened(found: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The prefixes with ``single``: the sketch proves that no other conversation has them.

    ``top``: the prefix before is not proven so, which means that the tail begins here.
    """
    table = found.sparkSession.sparkContext.broadcast(sketch(found, most))

    def run(batches):
        for batch in batches:
            d1, d2, p1, p2, depth = (np.asarray(batch.column(c)) for c in ("d1", "d2", "p1", "p2", "depth"))
            single = table.value.single(d1, d2)
            top = single & ((depth == 0) | ~table.value.single(p1, p2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(top)], [*batch.schema.names, "single", "top"])

    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return found.mapInArrow(run, f"{schema}, single boolean, top boolean")


def _ends(shared: DataFrame) -> DataFrame:
    """``ends_sha256`` per digest: the members that end there, ascending, joined and hashed.

    Sorted ranges become texts of about a megabyte, which one task per node hashes in turn
    without holding them; that much is sequential by its nature.
    """
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shared.filter("last").select("d1", "d2", "conv").repartitionByRange(parts, "d1", "d2", "conv")

    def join(batches):
        key, held = None, []
        for batch in batches:
            done = []
            for d1, d2, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (d1, d2) != key or len(held) >= _CHUNK:
                    done += [chunk(key, held)] if held else []
                    key, held = (d1, d2), []
                held.append(c)
            yield table(done)
        yield table([chunk(key, held)] if held else [])

    def chunk(key, held):
        return (*key, held[0], ",".join(map(str, held)))

    def table(rows):
        kinds = {"d1": pa.int64(), "d2": pa.int64(), "least": pa.int64(), "ids": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
                if (d1, d2) != key:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = (d1, d2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield hashed(done)
        yield hashed([(*key, state.hexdigest())] if key else [])

    def hashed(rows):
        kinds = {"d1": pa.int64(), "d2": pa.int64(), "ends_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    chunks = rows.sortWithinPartitions("d1", "d2", "conv").mapInArrow(join, "d1 long, d2 long, least long, ids string")
    chunks = chunks.repartition(parts, "d1", "d2").sortWithinPartitions("d1", "d2", "least")
    return chunks.mapInArrow(digest, "d1 long, d2 long, ends_sha256 string")


def nodes(found: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The tree of the conversations in ``prefixes``, one row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    found = settled(found)
    found = settled(screened(found, most))
    tails, shared = found.filter("single"), found.filter("NOT single")
    node = ["d1", "d2"]

    grouped = settled(
        shared.groupBy(*node).agg(
            F.min("conv").alias("owner"),
            F.count(F.lit(1)).alias("n_convs"),
            F.any_value("depth").alias("depth"),
            F.any_value("p1").alias("p1"),
            F.any_value("p2").alias("p2"),
            F.any_value("size").alias("size"),
            F.any_value("before").alias("before"),
            F.sum(F.col("last").cast("long")).alias("n_ends"),
        )
    )
    # where each conversation's own nodes begin, and whether one of them has no child
    own = grouped.select(F.col("owner").alias("conv"), "before", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    own = own.unionAll(tails.filter("top OR last").select("conv", "before", F.col("last").alias("leaf")))
    own = own.groupBy("conv").agg(F.min("before").alias("saved_to"), F.max("leaf").alias("leaf"))
    whole = found.filter("last").select("conv", (F.col("before") + F.col("size")).alias("bytes"))
    paths = whole.join(own, "conv", "left").select(
        "conv", F.coalesce("saved_to", "bytes").alias("saved_to"), F.coalesce("leaf", F.lit(False)).alias("leaf")
    )
    paths = settled(paths)
    # by blocks, so that a long conversation is not one key
    spans = shared.groupBy("conv", F.floor(F.col("depth") / BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    members = shared.select("conv", "d1", "d2", "before", F.floor(F.col("depth") / BLOCK).alias("block"))
    members = members.join(spans.join(paths, "conv").drop("n"), ["conv", "block"])
    subtrees = members.groupBy(*node).agg(
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("saved_to") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    # every node under a grouped one: of a tail only its beginning
    below = grouped.select("p1", "p2", "depth").unionAll(tails.filter("top").select("p1", "p2", "depth")).filter("depth > 0")
    children = below.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))

    full = grouped.join(subtrees, node).join(children, node, "left").join(_ends(shared), node, "left")
    full = settled(
        full.select(
            *node, "p1", "p2", "depth", F.col("owner").alias("conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"),
            F.col("saved_tokens").cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
    lone = lambda rows, *more: rows.select(
        *more, "depth", F.col("conv").alias("conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(F.col("last"), F.col("conv").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )
    out = _with_parents(full.unionByName(lone(tails.filter("top"), *node, "p1", "p2")), full)
    return out.unionByName(lone(tails.filter("NOT top"), F.col("conv").alias("parent_conv_id")))


def _with_parents(every: DataFrame, full: DataFrame) -> DataFrame:
    """``parent_conv_id``: the parent's smallest member, which of a parent in a tail is the node's own.

    Parents of more than a ``_HEAVY``-th of all nodes, fewer than ``_HEAVY``, are broadcast, so
    that no key of the shuffle has more children than that share.
    """
    total = full.agg(F.sum("n_children")).first()[0] or 0
    limit = -(-total // _HEAVY)
    parents = full.filter("n_children > 0").select(
        F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"), "n_children"
    )
    heavy = parents.filter(F.col("n_children") > limit).drop("n_children").withColumnRenamed("parent", "heavy")
    light = parents.filter(F.col("n_children") <= limit).drop("n_children")
    out = every.join(F.broadcast(heavy), ["p1", "p2"], "left")
    missing, known = out.filter("heavy IS NULL AND depth > 0"), out.filter("heavy IS NOT NULL OR depth = 0")
    joined = missing.join(light, ["p1", "p2"], "left").unionByName(known.withColumn("parent", F.col("heavy")))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return joined.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def tree(rows: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The prefix tree of conversations as they are."""
    given = settled(turns(rows))
    return nodes(prefixes(given, given.select("conv").distinct()), most)


def tree_of_families(rows: DataFrame, heads: Column, longest: int, family: int, most: int = MOST_CELLS) -> DataFrame:
    """The prefix tree of conversations rebuilt with ``shared_heads``."""
    given = settled(turns(rows))
    return nodes(prefixes(*shared_heads(given, heads, longest, family)), most)
