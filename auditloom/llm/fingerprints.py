"""Fingerprints of documents: a threshold-scaled sketch of their shingles.

A shingle is ``WIDTH`` consecutive bytes of the UTF-8 of a text (a shorter text that is not
empty is one shingle). Of the distinct 48-bit shingle hashes a sketch keeps every one below
``2**48 / SCALE``. So it grows with the text and is a uniform sample of its shingles, and
the sketches of a short and of a very long text are comparable: the share of the short
one's kept hashes that the other one keeps too estimates how much of the short text the long
one contains. The sketch of several texts together is the union of theirs.

A text none of whose hashes is below the threshold keeps its smallest hash, so that only the
empty text has an empty sketch; the union of sketches drops such a hash where another is below.

A fingerprint is the sorted hashes as text, eight letters each (base64 of six bytes).

To see its neighbour, each document is dealt into ranges of ids, which hold a copy of the
next range's first document, and read in order; texts are shuffled once, and a task keeps
two documents and a slice of about a megabyte.

Edge cases: a null text is empty; an empty text has the fingerprint ``''`` and a likeness of
1 to an empty one, 0 to any other; documents of one id follow each other by a hash of their
text, equal rows each follow the other; a null id comes first; the only document is its own
next one; texts of any length are taken whole; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.ordered import in_ranges
from auditloom.llm.words import _BYTES, BLOCK, mixed, slices

WIDTH = 16
SCALE = 32
PART_BYTES = 64 << 20
_BITS = 48
_U = np.uint64


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all runs of ``width`` bytes, by their first byte."""
    _BYTES.reach(BLOCK + width + 1)
    out = np.empty(max(0, len(data) - width + 1), _U)
    for at in range(0, len(out), BLOCK):
        to = min(at + BLOCK, len(out))
        part = data[at : to + width - 1].astype(_U)
        part += _U(1)
        part *= _BYTES.up[: len(part)]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part, out=sums[1:])
        out[at:to] = mixed((sums[width:] - sums[:-width]) * _BYTES.down[: to - at] + _U(width))
    out >>= _U(64 - _BITS)
    return out


def sketches(texts: list[bytes], width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted kept hashes of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes = _hashes(data, width)
    ends = np.cumsum(lengths)
    at = np.flatnonzero(hashes < _U((1 << _BITS) // scale))
    owner = np.searchsorted(ends, at, side="right")
    inside = at + width <= ends[owner] if len(at) else np.empty(0, bool)
    at, owner = at[inside], owner[inside]
    kept, bounds = hashes[at], np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
        own = kept[bounds[k] : bounds[k + 1]]
        if not len(own) and n:
            own = hashes[end - n : end - width + 1] if n >= width else _hashes(data[end - n : end], n)
            own = own.min(keepdims=True)
        out.append(np.unique(own))
    return out


def written(sketch: np.ndarray) -> str:
    """The fingerprint: eight letters a hash."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The share of kept hashes that both have; 1 for two empty sketches."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def hashes(fingerprint: Column) -> Column:
    """The kept hashes of a fingerprint, as an array of texts of eight letters."""
    return F.regexp_extract_all(fingerprint, F.lit("(.{8})"), F.lit(1))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of ``a``'s shingles that ``b`` has; null if ``a`` is empty."""
    own = hashes(a)
    return F.when(a != "", F.size(F.array_intersect(own, hashes(b))) / F.size(own))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles among those of both."""
    both, either = F.size(F.array_intersect(hashes(a), hashes(b))), F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def pooled(prints: DataFrame, by: list[str], scale: int = SCALE, col: str = "fingerprint") -> DataFrame:
    """The sketch of all documents of each group together, one row per group and ``hash``.

    In long form, as the sketch of a group grows with the group. A hash above the threshold
    stays only where the group has no other.
    """
    limit = written(np.array([(1 << _BITS) // scale], _U))
    each = prints.select(*by, F.explode(hashes(F.col(col))).alias("hash")).distinct()
    each = each.withColumn("low", F.unbase64("hash") < F.unbase64(F.lit(limit)))
    least = F.min(F.struct(F.unbase64("hash").alias("value"), F.col("hash")))["hash"]
    high = each.groupBy(*by).agg(F.max("low").alias("any_low"), least.alias("hash")).filter(~F.col("any_low"))
    return each.filter("low").select(*by, "hash").unionAll(high.select(*by, "hash"))


def fingerprints(
    docs: DataFrame, width: int = WIDTH, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's id and ``fingerprint``, in one scan without a shuffle."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                prints = [written(s) for s in sketches(texts, width, scale)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(prints, pa.string())], ["id", "fingerprint"])

    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """How many characters ``text`` has, and it with its last quarter replaced by the other's start."""
    own = text.decode()
    cut = len(own) // 4
    head = following[: 4 * cut].decode(errors="ignore")[:cut]
    return len(own), (own[: len(own) - cut] + head).encode()


def with_neighbours(
    docs: DataFrame, width: int = WIDTH, scale: int = SCALE, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document against its edited text and the next document, by ascending id.

    Columns: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (likeness of the fingerprints).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("print"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, parts = in_ranges(given, ["id", "print"], max(least, -(-size // part_bytes)), closed=True)
    ranged = ranged.repartition(parts, "__part").sortWithinPartitions("__part", "__next", "id", "print")

    def run(batches):
        held = None  # the last row read: its next one is still to come
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                ids, parts, marks = (batch.column(c).slice(at, len(texts)).to_pylist() for c in ("id", "__part", "__next"))
                rows = [*([held] if held else []), *zip(ids, parts, marks, texts, strict=True)]
                held = rows[-1]
                if len(rows) > 1:
                    yield _compared(rows, width, scale, id_arrow)

    id_arrow = _arrow_type(given.select("id"))
    found = ranged.mapInArrow(
        run,
        f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return found.withColumnRenamed("id", id_col)


def _arrow_type(ids: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(ids.schema["id"].dataType)


def _compared(rows: list[tuple], width: int, scale: int, id_type: pa.DataType) -> pa.RecordBatch:
    """All rows but the last, and but copies, each against the row after it."""
    own = sketches([r[3] for r in rows], width, scale)
    at = [i for i in range(len(rows) - 1) if not rows[i][2]]
    changed = [edited(rows[i][3], rows[i + 1][3]) for i in at]
    other = sketches([t for _, t in changed], width, scale)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in at], id_type),
            pa.array([n for n, _ in changed], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for _, t in changed], pa.string()),
            pa.array([written(own[i]) for i in at], pa.string()),
            pa.array([written(s) for s in other], pa.string()),
            pa.array([jaccard(own[i], s) for i, s in zip(at, other, strict=True)], pa.float64()),
            pa.array([jaccard(own[i], own[i + 1]) for i in at], pa.float64()),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
