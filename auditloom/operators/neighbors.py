"""Nearest neighbours in blocks of bounded size, without meeting all pairs.

``exact``: an index of cells. A row belongs to its nearest centre (centres are fitted on a
bounded sample) and to a ring of distances around it; rows are packed into tiles in the order of
class, cell and ring, one row per tile. A tile is first searched by itself, its blocks before the
rest, which bounds how far each row's k nearest can be. Then each tile meets every other one of
its class in a Cartesian product of the settled tiles, so that no pair of tiles is shuffled. By the
triangle inequality the bound proves for most cells and rings that they hold nothing nearer; of the
others, one matrix product in single precision, with a margin for its rounding, finds the pairs
that can be within the bound, and only their distances are computed in full. A row's bound shrinks
with what it finds, and a task gives back no more than its k nearest of those it met. Centres and
rings decide how much is skipped, never what is found. On vectors without any structure, nothing
can be skipped between cells, and all tiles of a class meet.

``lsh``: vectors are hashed by the sides of random hyperplanes they are on, several times
over, and only vectors of equal hash meet, in blocks. A row also looks where its least certain
sides would be turned round. The number of sides grows with the logarithm of the number of
rows, so that buckets stay small; that of tables follows from the wanted recall of neighbours
at a given cosine. Where few tables do, a vector is sent to each of its buckets. Where these are
more than the tiles of its class (a low cosine asks for tables almost in proportion to the rows),
it is sent to the tiles instead: two tiles at a time are hashed and matched table by table, and
only rows of equal hash are compared, once however many tables they share. And where the buckets
that a row looks into hold so large a share of all rows that one product with all of them costs
less, the order is turned round: the product finds a row's nearest candidates, and of these, the
nearest first, those count that share a bucket in any table. A row that finds fewer than k among
its candidates is searched by buckets; what is found is the same.

Rows with a null key, a null vector or a null component take no part, nor do rows without a
class where one is asked for.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import Accumulator, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.columns import col
from auditloom.session import settled

BLOCK_ROWS = 4_096
MOST_CENTRES = 1_024
RINGS = 4
SAMPLE_ROWS = 8_192
#: Rows of a tile, and rows of the meeting side that one task holds.
LEAST_TILE, MOST_TILE, TASK_ROWS = 1_024, 8_192, 1 << 16
CHUNK = 1_024
BUCKET_ROWS = 4
UNSURE = 2
#: Leading sides by which rows of a tile are looked up, and sides that a task computes at once.
COARSE_BITS, CELLS = 16, 1 << 22
#: What looking up a row in a bucket costs more than its cell of a product, about; candidates for each
#: neighbour that is wanted, tables that these are tried on at first, and rows that are met at first.
LOOK_UP, CANDIDATES, FIRST_TABLES, FIRST_ROWS = 16, 3, 64, 256
#: Cells of a product that are held at once: what a core's cache holds.
STRIP_CELLS = 1 << 20
RECALL, NEAR = 0.95, 0.8
SEED = 42

# The small functions below travel with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _closest(q: np.ndarray, q_ids, b: np.ndarray, b_ids, k: int, drop_self=False, slice_rows: int = 1024):
    """(query position, base position, distance) of the k nearest base rows per query.

    A matrix product finds who can be among the nearest, with a margin for rounding;
    their distances are then computed directly. Equal distances go by id.
    """
    found = []
    margin = 1e-12 * q.shape[1] * ((q * q).sum(1).max() + (b * b).sum(1).max()) + 1e-300
    for start in range(0, len(q), slice_rows):
        part = q[start : start + slice_rows]
        near = _squared(part, b)
        if drop_self:
            near[q_ids[start : start + slice_rows][:, None] == b_ids[None, :]] = np.inf
        limit = np.full(len(part), np.inf)
        if near.shape[1] > k:
            limit = np.partition(near, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero((near <= (limit + margin)[:, None]) & np.isfinite(near))
        diff = part[rows] - b[cols]
        dist = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((b_ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        found.append((rows[keep] + start, cols[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _marked(alive: np.ndarray) -> np.ndarray:
    """Positions of the true cells in flat order; quick where they are few, as eight are looked at as one."""
    flat = alive.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class _Product:
    """Which pairs of two sets of rows can be within the limit of the first, and maybe some beyond.

    One product in single precision, of vectors scaled to one at most: |q - b| <= limit where
    q b - |b|^2 / 2 >= (|q|^2 - limit^2) / 2, less what rounding can take off.
    """

    def __init__(self, q: np.ndarray, b: np.ndarray):
        norm_q, norm_b = (np.sqrt((x * x).sum(1)) for x in (q, b))
        self.fine_q, self.fine_b = np.isfinite(norm_q), np.isfinite(norm_b)
        self.scale = max(norm_q[self.fine_q].max(initial=0.0), norm_b[self.fine_b].max(initial=0.0)) or 1.0
        left, right = (np.where(fine[:, None], x, 0.0) / self.scale for x, fine in ((q, self.fine_q), (b, self.fine_b)))
        half = np.where(self.fine_b, -((norm_b / self.scale) ** 2) / 2, 0.0)
        self.left = np.column_stack([left, np.ones(len(q))]).astype(np.float32)
        self.right = np.column_stack([right, half]).astype(np.float32)
        self.least = np.where(self.fine_q, (norm_q / self.scale) ** 2 / 2 - (q.shape[1] + 8) * 2.0**-22, np.inf)

    def pairs(self, asks: np.ndarray, told: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of those among the rows ``asks`` and ``told``; a strip of cells is held at a time."""
        least = np.where(self.fine_q[asks], self.least[asks] - (limits[asks] / self.scale) ** 2 / 2, np.inf).astype(np.float32)
        left, right = self.left[asks], self.right[told].T
        strip = max(1, STRIP_CELLS // len(told))
        cells, alive = np.empty((strip, len(told)), np.float32), np.empty((strip, len(told)), bool)
        found = []
        for at in range(0, len(asks), strip):
            n = min(strip, len(asks) - at)
            np.matmul(left[at : at + n], right, out=cells[:n])
            np.greater_equal(cells[:n], least[at : at + n, None], out=alive[:n])
            found.append(at * len(told) + _marked(alive[:n]))
        rows, cols = np.divmod(np.concatenate(found), len(told))
        rows, cols = asks[rows], told[cols]
        fine = self.fine_b[cols]
        return rows[fine], cols[fine]


def _distances(x: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray, some: int = 1 << 14) -> np.ndarray:
    """Of pairs of rows; the vectors of some pairs are held at a time."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), some):
        diff = x[rows[at : at + some]] - b[cols[at : at + some]]
        out[at : at + some] = (diff * diff).sum(1)
    return np.sqrt(out)


class _Nearest:
    """The k nearest rows found so far for each row of a tile, and how far they can be at most."""

    chunk = CHUNK

    def __init__(self, x, ids, k, drop_self, limits, once=False):
        """``once``: a neighbour that is met in several rows counts once, at its least distance."""
        self.x, self.ids, self.k, self.drop_self, self.limits, self.once = x, ids, k, drop_self, limits, once
        self.rows, self.near, self.dist = np.empty(0, np.int64), ids[:0], np.empty(0)

    def take(self, rows, near, dist, cols=None):
        """Merges what was found, of which only the rows concerned are ordered anew; ties go by id. ``cols``: where it stands."""
        if not len(rows):
            return
        hit = np.zeros(len(self.x), bool)
        hit[rows] = True
        old = hit[self.rows]
        kept = self.rows[~old], self.near[~old], self.dist[~old]
        rows, near, dist = (np.concatenate(z) for z in ((self.rows[old], rows), (self.near[old], near), (self.dist[old], dist)))
        if self.once:
            order = np.lexsort((dist, near, rows))
            rows, near, dist = rows[order], near[order], dist[order]
            new = np.append(True, (rows[1:] != rows[:-1]) | (near[1:] != near[:-1]))
            rows, near, dist = rows[new], near[new], dist[new]
        order = np.lexsort((near, dist, rows))
        rows, near, dist = rows[order], near[order], dist[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.limits[rows[last]] = np.minimum(self.limits[rows[last]], dist[last])
        some = place < self.k
        self.rows, self.near, self.dist = (np.concatenate(z) for z in zip(kept, (rows[some], near[some], dist[some]), strict=True))

    def meet(self, b, b_ids, needed_of=None, blocks=None, b_blocks=None, pairs: int = 1 << 18, strict: bool = False) -> int:
        """Looks among the rows of ``b``, but not at pairs of one block; returns how many distances were computed.

        ``needed_of`` says for a slice of them which pairs no cell excludes, by rows and kinds, and of which kind
        each one is; ``strict``: no others are taken.
        """
        computed, product = 0, _Product(self.x, b)
        for at in range(0, len(b), self.chunk):
            part = slice(at, at + self.chunk)
            needed, which = needed_of(part, self.limits) if needed_of else (None, None)
            asks = np.arange(len(self.x)) if needed is None else np.flatnonzero(needed.any(1))
            told = np.arange(at, min(at + self.chunk, len(b))) if needed is None else at + np.flatnonzero(needed.any(0)[which])
            for few, close in ((asks[np.isinf(self.limits[asks])], True), (asks[~np.isinf(self.limits[asks])], False)):
                if not len(few) or not len(told):
                    continue
                if close and blocks is None and not strict:
                    rows, cols, dist = _closest(self.x[few], self.ids[few], b[told], b_ids[told], self.k, self.drop_self)
                    computed += len(few) * len(told)
                    self.take(few[rows], b_ids[told[cols]], dist, told[cols])
                    continue
                rows, cols = product.pairs(few, told, self.limits)
                keep = np.ones(len(rows), bool) if needed is None else needed[rows, which[cols - at]]
                if blocks is not None:
                    keep &= blocks[rows] != b_blocks[cols]
                if self.drop_self:
                    keep &= self.ids[rows] != b_ids[cols]
                rows, cols = rows[keep], cols[keep]
                computed += len(rows)
                for first in range(0, len(rows), pairs):
                    r, c = rows[first : first + pairs], cols[first : first + pairs]
                    dist = _distances(self.x, r, b, c)
                    near = dist <= self.limits[r] * (1 + 1e-12)
                    self.take(r[near], b_ids[c[near]], dist[near], c[near])
        return computed


class _Candidates(_Nearest):
    """The nearest rows found so far, each row of a tile by itself, and where these stand among all that were met."""

    chunk = 2 * CHUNK

    def __init__(self, x, ids, k, drop_self):
        super().__init__(x, ids, k, drop_self, np.full(len(x), np.inf))
        self.met, self.n_met, self.places = [], 0, np.empty(0, np.int64)

    def meet(self, b, b_ids, **options) -> int:
        computed, at = 0, 0
        while at < len(b):  # as many as were met before, so that limits shrink before the most are met
            part = slice(at, at + max(FIRST_ROWS, self.n_met))
            computed += super().meet(b[part], b_ids[part], **options)
            self.met.append(b[part])
            self.n_met += len(b[part])
            at = part.stop
        return computed

    def take(self, rows, near, dist, cols=None):
        hit = np.zeros(len(self.x), bool)
        hit[rows] = True
        old = hit[self.rows]
        held = self.rows, self.near, self.dist, self.places
        rows, near, dist, places = (np.concatenate([z[old], new]) for z, new in zip(held, (rows, near, dist, self.n_met + cols), strict=True))
        order = np.lexsort((places, near, dist, rows))
        rows, near, dist, places = (z[order] for z in (rows, near, dist, places))
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = nth == self.k - 1
        self.limits[rows[last]] = np.minimum(self.limits[rows[last]], dist[last])
        some = nth < self.k
        self.rows, self.near, self.dist, self.places = (np.concatenate([z[~old], new[some]]) for z, new in zip(held, (rows, near, dist, places), strict=True))

    def sharing(self, k: int, planes, bits: int, unsure: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the candidates share a bucket, the nearest ``k`` at least; the rows that may have nearer ones elsewhere."""
        order = np.lexsort((self.places, self.near, self.dist, self.rows))
        self.rows, self.near, self.dist, self.places = (z[order] for z in (self.rows, self.near, self.dist, self.places))
        edges = np.cumsum([0, *(len(b) for b in self.met)])
        ends = np.searchsorted(self.rows, np.arange(len(self.x)), side="right")
        n_held = np.diff(np.append(0, ends))
        following, have = ends - n_held, np.zeros(len(self.x), np.int64)
        share = np.zeros(len(self.rows), bool)
        while True:
            n = np.where(have < k, np.minimum(k - have, ends - following), 0)
            if not n.any():
                break
            which = np.repeat(following, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            following = following + n
            places, back = np.unique(self.places[which], return_inverse=True)
            tile = np.searchsorted(edges, places, side="right") - 1
            vectors = np.stack([self.met[t][at] for t, at in zip(tile, places - edges[tile], strict=True)])
            share[which] = _sharing_pairs(self.x, vectors, self.rows[which], back, planes, bits, unsure)
            found = np.flatnonzero(share)
            by_id = found[np.lexsort((self.near[found], self.rows[found]))]
            rows, near = self.rows[by_id], self.near[by_id]
            new = np.append(True, (rows[1:] != rows[:-1]) | (near[1:] != near[:-1]))[: len(rows)]
            have = np.bincount(rows[new], minlength=len(self.x))
        return share, np.flatnonzero((have < k) & (n_held >= self.k))


class _Index:
    """Centres and the width of rings, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, n_centres: int):
        rng = np.random.default_rng(SEED)
        self.centres = sample[rng.permutation(len(sample))[:n_centres]]
        for _ in range(4):
            own = _squared(sample, self.centres).argmin(1)
            counts = np.bincount(own, minlength=len(self.centres))
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, sample)
            self.centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        self.width = max(float(np.sqrt(_squared(sample, self.centres).min(1)).max()) / RINGS, 1e-9)
        self.between = np.sqrt(_squared(self.centres, self.centres))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the ring of each row."""
        far = _squared(x, self.centres)
        cell = far.argmin(1)
        ring = np.minimum(np.sqrt(far[np.arange(len(x)), cell]) / self.width, RINGS - 1).astype(np.int64)
        return cell, ring

    def least(self, x: np.ndarray, own, cells: np.ndarray, rings: np.ndarray, far: np.ndarray | None = None) -> np.ndarray:
        """No row of these cells and rings is nearer to the row of ``x``, of cell ``own``, than this."""
        own, far = np.atleast_1d(own), np.sqrt(_squared(x, self.centres)) if far is None else far
        to = far[:, cells]
        inner = rings * self.width - to
        outer = np.where(rings < RINGS - 1, to - (rings + 1) * self.width, -np.inf)
        # a row of another cell is on that centre's side of the plane half-way
        apart = self.between[own[:, None], cells[None, :]]
        beyond = (to**2 - far[np.arange(len(x)), own][:, None] ** 2) / np.where(apart > 0, 2 * apart, np.inf)
        return np.maximum(np.maximum(inner, outer), np.maximum(beyond, 0.0)) - 1e-7 * (1.0 + to)


def _blocks(points: DataFrame, keys: list[str], key_type: str, block_rows: int) -> DataFrame:
    """One row per block of rows with equal ``keys``: the keys, __sub, __ids, __vectors."""
    sizes = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__subs"))
    dealt = points.join(sizes, keys).withColumn("__sub", F.pmod(F.xxhash64("__id"), F.col("__subs")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame(
            {**{k: [first[k]] for k in [*keys, "__sub", "__subs"]}, "__ids": [pdf["__id"].tolist()], "__vectors": [_matrix(pdf["__vec"]).tobytes()]}
        )

    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return dealt.groupBy(*keys, "__sub", "__subs").applyInPandas(
        pack, f"{schema}, __sub int, __subs int, __ids array<{key_type}>, __vectors binary"
    )


def _points(df: DataFrame, key: str, vector: str, within: str | None) -> DataFrame:
    return df.select(
        col(key).alias("__id"),
        (col(within).cast("string") if within else F.lit("")).alias("__group"),
        col(vector).cast("array<double>").alias("__vec"),
    ).where("__id is not null and __group is not null and __vec is not null and not exists(__vec, x -> x is null)")


def nearest_neighbours(
    df: DataFrame,
    key: str,
    vector: str,
    k: int,
    within: str | None = None,
    include_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    method: str = "exact",
    near: float = NEAR,
    recall: float = RECALL,
    bits: int | None = None,
    tables: int | None = None,
    work: Accumulator | None = None,
) -> DataFrame:
    """(key, neighbour, rank, distance): the k nearest rows of each row, Euclidean.

    ``within`` restricts neighbours to rows of the same class. Ties go to the lower
    key. A row with fewer than k possible neighbours gets all there are.

    ``lsh`` aims at ``recall`` of the neighbours with a cosine of ``near`` or more; ``bits``
    and ``tables`` follow from that and the number of rows unless given. ``work`` counts the
    pairs whose distance is computed in full.
    """
    if method not in ("exact", "lsh"):
        raise ValueError("method is 'exact' or 'lsh'")
    key_type = df.schema[key].dataType.simpleString()
    points = _points(df, key, vector, within)
    if method == "exact":
        found = _exact(points, key_type, k, include_self, block_rows, work)
    else:
        found = _hashed(points, key_type, k, include_self, block_rows, near, recall, bits, tables, work)
    order = W.partitionBy("__id").orderBy("distance", "neighbour")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("__id").alias(key), "neighbour", "rank", "distance")
    )


def _exact(points: DataFrame, key_type: str, k: int, include_self: bool, block_rows: int, work: Accumulator | None) -> DataFrame:
    sizes = points.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    largest, total = sizes["largest"] or 0, sizes["total"] or 0
    index = None
    if largest > block_rows:  # else every class is one block
        every = max(1, total // SAMPLE_ROWS)
        some = points.where(F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(every)) == 0).select("__vec").limit(4 * SAMPLE_ROWS)
        sample = _matrix(some.toPandas()["__vec"])
        index = _Index(sample, min(MOST_CENTRES, -(-largest // (RINGS * block_rows))))  # a bin has about a block's rows

    def place(batches):
        for batch in batches:
            cell, ring = index.place(_matrix(batch["__vec"])) if index and len(batch) else (np.zeros(len(batch), int),) * 2
            yield batch.assign(__cell=cell, __ring=ring)

    bin_keys = ["__group", "__cell", "__ring"]
    placed = points.mapInPandas(place, f"__id {key_type}, __group string, __vec array<double>, __cell int, __ring int")
    if index is None:
        return _each_alone(_blocks(placed, bin_keys, key_type, block_rows), key_type, k, include_self, work)

    tile_rows = max(block_rows, min(MOST_TILE, max(LEAST_TILE, total // 32)))
    tiles = settled(_tiles(placed, bin_keys, key_type, tile_rows, block_rows, index, k, include_self, work))
    result = f"__id {key_type}, neighbour {key_type}, distance double"

    def own(batches):
        for batch in batches:
            for ids, rows, near, dist in zip(batch["ids"], batch["own_rows"], batch["own_near"], batch["own_dist"]):
                yield pd.DataFrame({"__id": np.asarray(ids)[np.frombuffer(rows, np.int64)], "neighbour": np.asarray(near), "distance": np.frombuffer(dist)})

    alone = tiles.select("ids", "own_rows", "own_near", "own_dist").mapInPandas(own, result)
    # only classes of several tiles have anything left to meet
    many = tiles.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_meeting = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n_meeting:
        return alone
    meeting = tiles.join(many.select("__group"), "__group", "left_semi")
    asks = meeting.select(F.col("__group").alias("q_group"), F.col("tile").alias("q_tile"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "cells", "limits")])
    asks, told = asks.repartition(n_meeting), meeting.select("__group", "tile", "ids", "vectors", "cells", "rings").repartition(_tasks(n_meeting, tile_rows))
    same_class = (F.col("q_group") == F.col("__group")) & (F.col("q_tile") != F.col("tile"))
    met = asks.join(told.hint("shuffle_replicate_nl"), same_class).drop("q_group", "__group")

    def search(batches):
        at, state, q_cells, far, seen = None, None, None, None, 0

        def done():
            return pd.DataFrame({"__id": state.ids[state.rows], "neighbour": state.near, "distance": state.dist})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q_tile != at:  # a tile meets the others one after the other
                    if state is not None:
                        yield done()
                    x, ids = np.frombuffer(row.q_vectors).reshape(len(row.q_ids), -1), np.asarray(row.q_ids)
                    at, q_cells = row.q_tile, np.frombuffer(row.q_cells, np.int32)
                    state = _Nearest(x, ids, k, not include_self, np.frombuffer(row.q_limits).copy())
                    far = np.sqrt(_squared(x, index.centres))
                b = np.frombuffer(row.vectors).reshape(len(row.ids), -1)
                needed = _needed(index, state.x, q_cells, far, np.frombuffer(row.cells, np.int32), np.frombuffer(row.rings, np.int32))
                seen = state.meet(b, np.asarray(row.ids), needed)
                if work is not None:
                    work.add(int(seen))
        if state is not None:
            yield done()

    return alone.unionAll(met.mapInPandas(search, result))


def _tasks(n_tiles: int, tile_rows: int) -> int:
    return -(-n_tiles // max(1, TASK_ROWS // tile_rows))


def _each_alone(blocks: DataFrame, key_type: str, k: int, include_self: bool, work: Accumulator | None) -> DataFrame:
    def own(batches):
        for batch in batches:
            for ids, vectors in zip(batch["__ids"], batch["__vectors"]):
                x, names = np.frombuffer(vectors).reshape(len(ids), -1), np.asarray(ids)
                rows, cols, dist = _closest(x, names, x, names, k, drop_self=not include_self)
                if work is not None:
                    work.add(len(names) ** 2)
                yield pd.DataFrame({"__id": names[rows], "neighbour": names[cols], "distance": dist})

    return blocks.select("__ids", "__vectors").mapInPandas(own, f"__id {key_type}, neighbour {key_type}, distance double")


def _needed(index: _Index, x, own, far, cells, rings):
    """For a slice of rows of these cells and rings, in order: which cells and rings are not excluded for each row of ``x``,
    and in which each row of the slice lies."""
    bins = cells.astype(np.int64) * RINGS + rings

    def of(part, limits):
        names, which = np.unique(bins[part], return_inverse=True)
        needed = index.least(x, own, names // RINGS, names % RINGS, far) <= limits[:, None]
        return (None, None) if needed.all() else (needed, which)

    return of


def _tiles(placed, bin_keys, key_type, tile_rows, block_rows, index, k, include_self, work) -> DataFrame:
    """One row per tile: rows in the order of cell and ring, and what each finds in its own tile."""
    sizes = placed.groupBy(*bin_keys).agg(F.count(F.lit(1)).alias("n"))  # at most cells x rings a class
    before = W.partitionBy("__group").orderBy("__cell", "__ring").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        *bin_keys, F.floor(F.col("start") / tile_rows).alias("__first"), F.ceil(F.col("n") / tile_rows).alias("__subs")
    )
    dealt = placed.join(starts, bin_keys).withColumn(
        "tile", F.concat_ws("|", "__first", F.when(F.col("__subs") > 1, F.concat_ws("|", "__cell", "__ring", F.pmod(F.xxhash64("__id", "__vec"), "__subs"))).otherwise("||"), "__group")
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__cell", "__ring"], kind="stable")
        x, ids = _matrix(pdf["__vec"]), pdf["__id"].to_numpy()
        cells, rings = (pdf[c].to_numpy().astype(np.int32) for c in ("__cell", "__ring"))
        state = _Nearest(x, ids, k, not include_self, np.full(len(x), np.inf))
        # the rows of a cell and ring first, in blocks
        change = np.append(True, (cells[1:] != cells[:-1]) | (rings[1:] != rings[:-1]))
        nth = np.arange(len(x)) - np.maximum.accumulate(np.where(change, np.arange(len(x)), 0))
        blocks = np.cumsum(change | (nth % block_rows == 0))
        edges = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(x))
        computed = 0
        for start, end in zip(edges, edges[1:]):
            mine = slice(start, end)
            rows, cols, dist = _closest(x[mine], ids[mine], x[mine], ids[mine], k, drop_self=not include_self)
            computed += (end - start) ** 2
            state.take(rows + start, ids[mine][cols], dist)
        far = np.sqrt(_squared(x, index.centres))
        computed += state.meet(x, ids, _needed(index, x, cells, far, cells, rings), blocks, blocks)
        if work is not None:
            work.add(int(computed))
        first = pdf.iloc[0]
        return pd.DataFrame({
            "__group": [first["__group"]], "tile": [first["tile"]], "ids": [ids.tolist()], "vectors": [x.tobytes()], "cells": [cells.tobytes()],
            "rings": [rings.tobytes()], "limits": [state.limits.tobytes()], "own_rows": [state.rows.astype(np.int64).tobytes()],
            "own_near": [state.near.tolist()], "own_dist": [state.dist.tobytes()],
        })

    return dealt.select("__id", "__group", "__vec", "__cell", "__ring", "tile").groupBy("tile").applyInPandas(
        pack,
        f"__group string, tile string, ids array<{key_type}>, vectors binary, cells binary, rings binary, limits binary, "
        f"own_rows binary, own_near array<{key_type}>, own_dist binary",
    )


def tables_for(near: float, recall: float, bits: int, unsure: int) -> int:
    """How many tables find ``recall`` of the rows at a cosine of ``near``, by simulation.

    A table finds a row if all sides agree but the asking row's ``unsure`` least certain ones.
    """
    rng = np.random.default_rng(SEED)
    x, z = rng.normal(size=(2, 100_000, bits))
    differ = (x > 0) != (near * x + math.sqrt(1 - near * near) * z > 0)
    sure = np.argsort(np.abs(x), axis=1)[:, min(unsure, bits) :]
    once = float((~np.take_along_axis(differ, sure, axis=1)).all(1).mean())
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(once, 1 - 1e-9)))) if once > 0 else 1_000


def _buckets(x: np.ndarray, planes: np.ndarray, bits: int, unsure: int = 0) -> np.ndarray:
    """(row, table, bucket): the bucket of each vector in each table, and all that differ in its ``unsure`` least certain sides."""
    over = (x @ planes).reshape(len(x), -1, bits)
    sides = np.packbits(over > 0, axis=2, bitorder="little")
    buckets = np.zeros((*over.shape[:2], 8), np.uint8)
    buckets[:, :, : sides.shape[2]] = sides
    buckets = buckets.view("<i8").astype(np.int64, copy=False)
    if unsure:
        turned = 1 << np.argpartition(np.abs(over), unsure - 1, axis=2)[:, :, :unsure]
        for t in range(unsure):
            buckets = np.concatenate([buckets, buckets ^ turned[:, :, [t]]], axis=2)
    return buckets


def _sharing(q: np.ndarray, b: np.ndarray, planes: np.ndarray, bits: int, unsure: int) -> np.ndarray:
    """Which rows of ``q`` look into a bucket with which rows of ``b``, in any table; some tables at a time."""
    share = np.zeros((len(q), len(b)), bool)
    coarse = max(0, bits - COARSE_BITS)
    step = max(1, CELLS // (bits * max(len(q), len(b)))) * bits
    for first in range(0, planes.shape[1], step):
        some = planes[:, first : first + step]
        for sides, asked in zip(_buckets(b, some, bits)[:, :, 0].T, _buckets(q, some, bits, unsure).transpose(1, 0, 2)):
            order = np.argsort((sides >> coarse).astype(np.uint16), kind="stable")
            ends = np.cumsum(np.bincount(sides >> coarse, minlength=1 << (bits - coarse)))
            to = ends[asked.ravel() >> coarse]
            n = to - np.append(0, ends)[asked.ravel() >> coarse]
            probe = np.repeat(np.arange(len(n)), n)
            cols = order[np.repeat(to - np.cumsum(n), n) + np.arange(len(probe))]
            if coarse:
                same = sides[cols] == asked.ravel()[probe]
                probe, cols = probe[same], cols[same]
            share[probe // asked.shape[1], cols] = True
    return share


def _sharing_pairs(q: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, planes: np.ndarray, bits: int, unsure: int) -> np.ndarray:
    """Which of some pairs share a bucket in any table; tables are tried, ever more at a time, until they do."""
    share, left = np.zeros(len(rows), bool), np.arange(len(rows))
    first, n_tables, step = 0, planes.shape[1] // bits, FIRST_TABLES
    while len(left) and first < n_tables:
        some = planes[:, first * bits : (first + step) * bits]
        some_pairs = max(1, STRIP_CELLS // some.shape[1])
        for at in range(0, len(left), some_pairs):
            pairs = left[at : at + some_pairs]
            (own, own_at), (other, other_at) = (np.unique(z[pairs], return_inverse=True) for z in (rows, cols))
            asked, sides = _buckets(q[own], some, bits, unsure), _buckets(b[other], some, bits)[:, :, 0]
            for turned in range(asked.shape[2]):
                share[pairs] |= (asked[own_at, :, turned] == sides[other_at]).any(1)
        left = left[~share[left]]
        first, step = first + step, 2 * step
    return share


def _hashed(points, key_type, k, include_self, block_rows, near, recall, bits, tables, work) -> DataFrame:
    sizes = points.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__vec")).alias("d"))
    first = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.max("d").alias("d")).first()
    total, largest = first["n"] or 0, first["largest"] or 0
    bits = bits or max(1, round(math.log2(max(2, total / BUCKET_ROWS))))
    tables = tables or tables_for(near, recall, bits, UNSURE)
    planes = np.random.default_rng(SEED).normal(size=(first["d"] or 1, tables * bits))
    unsure = min(UNSURE, bits)
    tile_rows = min(block_rows, max(LEAST_TILE, total // 32))
    if tables * (1 << unsure) * LOOK_UP >= 1 << bits:
        found = _hashed_candidates(points, key_type, k, include_self, tile_rows, planes, bits, unsure, work)
    elif -(-largest // tile_rows) <= tables * (1 + (1 << unsure)):
        found = _hashed_tiles(points, key_type, k, include_self, tile_rows, planes, bits, unsure, work)
    else:
        found = _hashed_buckets(points, key_type, k, include_self, block_rows, planes, bits, unsure, work)
    # a pair may meet in several tables
    return found.groupBy("__id", "neighbour").agg(F.min("distance").alias("distance"))


def _plain_tiles(points, key_type, tile_rows) -> DataFrame:
    return settled(
        _blocks(points, ["__group"], key_type, tile_rows).select("__group", F.concat_ws("|", "__sub", "__group").alias("tile"), F.col("__ids").alias("ids"), F.col("__vectors").alias("vectors"))
    )


def _asking(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.col("__group").alias("q_group"), F.col("tile").alias("q_tile"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors")])


def _bucket_search(k, include_self, planes, bits, unsure, work):
    """Of tiles that meet: the k nearest rows of those of equal hash."""

    def search(batches):
        at, state = None, None

        def done():
            return pd.DataFrame({"__id": state.ids[state.rows], "neighbour": state.near, "distance": state.dist})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q_tile != at:  # a tile meets the others one after the other
                    if state is not None:
                        yield done()
                    x, ids = np.frombuffer(row.q_vectors).reshape(len(row.q_ids), -1), np.asarray(row.q_ids)
                    at, state = row.q_tile, _Nearest(x, ids, k, not include_self, np.full(len(x), np.inf), once=True)
                b = np.frombuffer(row.vectors).reshape(len(row.ids), -1)
                share = _sharing(state.x, b, planes, bits, unsure)
                seen = state.meet(b, np.asarray(row.ids), lambda part, limits, share=share: (share[:, part], np.arange(share[:, part].shape[1])), strict=True)
                if work is not None:
                    work.add(int(seen))
        if state is not None:
            yield done()

    return search


def _hashed_tiles(points, key_type, k, include_self, tile_rows, planes, bits, unsure, work) -> DataFrame:
    """Each tile meets every one of its class; a vector is sent once for each tile."""
    tiles = _plain_tiles(points, key_type, tile_rows)
    result = f"__id {key_type}, neighbour {key_type}, distance double"
    search, told = _bucket_search(k, include_self, planes, bits, unsure, work), ["ids", "vectors"]
    alone = tiles.select(F.col("tile").alias("q_tile"), *[F.col(c).alias(f"q_{c}") for c in told], *told).mapInPandas(search, result)
    # only classes of several tiles have anything left to meet
    many = tiles.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_meeting = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n_meeting:
        return alone
    meeting = tiles.join(many.select("__group"), "__group", "left_semi")
    others = meeting.select("__group", "tile", *told).repartition(_tasks(n_meeting, tile_rows))
    same_class = (F.col("q_group") == F.col("__group")) & (F.col("q_tile") != F.col("tile"))
    met = _asking(meeting).repartition(n_meeting).join(others.hint("shuffle_replicate_nl"), same_class).select("q_tile", *[f"q_{c}" for c in told], *told)
    return alone.unionAll(met.mapInPandas(search, result))


def _hashed_candidates(points, key_type, k, include_self, tile_rows, planes, bits, unsure, work) -> DataFrame:
    """Each tile meets every one of its class, its own too, in products; only the nearest are tried for a common bucket."""
    tiles = _plain_tiles(points, key_type, tile_rows)
    n_tiles = tiles.count()
    result, told = f"__id {key_type}, neighbour {key_type}, distance double", ["ids", "vectors"]
    others = tiles.select("__group", *told).repartition(max(1, _tasks(n_tiles, tile_rows)))
    same_class = F.col("q_group") == F.col("__group")

    def meeting(asks: DataFrame) -> DataFrame:
        return asks.repartition(max(1, n_tiles)).join(others.hint("shuffle_replicate_nl"), same_class).select("q_tile", *[f"q_{c}" for c in told], *told)

    def search(batches):
        at, state = None, None

        def done():
            share, rest = state.sharing(k, planes, bits, unsure)
            return pd.DataFrame({
                "tile": [at], "ids": [state.ids[state.rows[share]].tolist()], "near": [state.near[share].tolist()],
                "dist": [state.dist[share].tobytes()], "rest": [rest.tolist()],
            })

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q_tile != at:  # a tile meets the others one after the other
                    if state is not None:
                        yield done()
                    x, ids = np.frombuffer(row.q_vectors).reshape(len(row.q_ids), -1), np.asarray(row.q_ids)
                    at, state = row.q_tile, _Candidates(x, ids, CANDIDATES * k, not include_self)
                seen = state.meet(np.frombuffer(row.vectors).reshape(len(row.ids), -1), np.asarray(row.ids))
                if work is not None:
                    work.add(int(seen))
        if state is not None:
            yield done()

    tried = settled(meeting(_asking(tiles)).mapInPandas(search, f"tile string, ids array<{key_type}>, near array<{key_type}>, dist binary, rest array<bigint>"))

    def each(batches):
        for batch in batches:
            for ids, near, dist in zip(batch["ids"], batch["near"], batch["dist"]):
                yield pd.DataFrame({"__id": np.asarray(ids), "neighbour": np.asarray(near), "distance": np.frombuffer(dist)})

    found = tried.select("ids", "near", "dist").mapInPandas(each, result)
    if not tried.agg(F.coalesce(F.sum(F.size("rest")), F.lit(0))).first()[0]:
        return found

    def only(batches):
        for batch in batches:
            for group, ids, vectors, rest in zip(batch["__group"], batch["ids"], batch["vectors"], batch["rest"]):
                rest = np.unique(np.concatenate(rest))
                x = np.frombuffer(vectors).reshape(len(ids), -1)
                yield pd.DataFrame({"__id": np.asarray(ids)[rest], "__group": group, "__vec": x[rest].tolist()})

    rest = tried.where(F.size("rest") > 0).groupBy("tile").agg(F.collect_list("rest").alias("rest"))
    few = tiles.join(rest, "tile").select("__group", "ids", "vectors", "rest").mapInPandas(only, f"__id {key_type}, __group string, __vec array<double>")
    return found.unionAll(meeting(_asking(_plain_tiles(few, key_type, tile_rows))).mapInPandas(_bucket_search(k, include_self, planes, bits, unsure, work), result))


def _hashed_buckets(points, key_type, k, include_self, block_rows, planes, bits, unsure, work) -> DataFrame:
    """Each bucket meets those that look into it, in blocks; a vector is sent to each of its buckets."""

    def sides(asking: bool):
        """The bucket of a vector in each table; of an asking one, all that differ in its least certain sides."""

        @F.pandas_udf("array<array<long>>")
        def of(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series([list(b) for b in _buckets(_matrix(vectors), planes, bits, unsure if asking else 0)])

        return of

    def dealt(asking: bool) -> DataFrame:
        hashed = points.select("__id", "__vec", "__group", F.posexplode(sides(asking)("__vec")).alias("__table", "__sides"))
        spread = hashed.select("__id", "__vec", "__group", "__table", F.explode("__sides").alias("__side"))
        keyed = spread.select("__id", "__vec", F.concat_ws("|", "__table", "__side", "__group").alias("__group"))
        return _blocks(keyed, ["__group"], key_type, block_rows)

    asking = dealt(True).select("__group", F.col("__ids").alias("q_ids"), F.col("__vectors").alias("q_vectors"))
    met = dealt(False).select("__group", F.col("__ids").alias("b_ids"), F.col("__vectors").alias("b_vectors")).join(asking, "__group")

    def search(batches):
        for batch in batches:
            for q_ids, q_vectors, b_ids, b_vectors in batch.itertuples(index=False):
                q, b = (np.frombuffer(v).reshape(len(i), -1) for v, i in ((q_vectors, q_ids), (b_vectors, b_ids)))
                q_ids, b_ids = np.asarray(q_ids), np.asarray(b_ids)
                rows, cols, dist = _closest(q, q_ids, b, b_ids, k, drop_self=not include_self)
                if work is not None:
                    work.add(len(q) * len(b))
                yield pd.DataFrame({"__id": q_ids[rows], "neighbour": b_ids[cols], "distance": dist})

    return met.select("q_ids", "q_vectors", "b_ids", "b_vectors").mapInPandas(
        search, f"__id {key_type}, neighbour {key_type}, distance double"
    )


def knn_consistency(
    df: DataFrame, key: str, vector: str, target: str, k: int = 5, include_self: bool = True,
    block_rows: int = BLOCK_ROWS, method: str = "exact",
) -> DataFrame:
    """1 - mean |y - mean y of the k nearest rows|; a row counts among its own neighbours."""
    near = nearest_neighbours(df, key, vector, k, include_self=include_self, block_rows=block_rows, method=method)
    labels = df.select(col(key).alias("id"), col(target).cast("double").alias("y"))
    mean_near = (
        near.join(labels.select(F.col("id").alias("neighbour"), F.col("y").alias("y_near")), "neighbour")
        .groupBy(col(key).alias("id"))
        .agg(F.avg("y_near").alias("near"))
    )
    return labels.join(mean_near, "id").agg(
        F.lit(k).alias("k"), (1.0 - F.avg(F.abs(F.col("y") - F.col("near")))).alias("consistency")
    )


def feature_vector(columns: Sequence[str]):
    return F.array(*[col(c).cast("double") for c in columns])
