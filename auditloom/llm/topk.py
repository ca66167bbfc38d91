"""Exact top-k inner products from an impact-ordered index, read score at a time.

Components are turned into whole numbers; a posting is one component of one vector, its
impact the size of that number. The index is made of shards of vectors, and each shard keeps
its postings in segments of descending impact. A batch of queries reads a segment of all
dimensions at once and adds it to the scores so far. What is still unread can change a score
by no more than the product of the two lengths involved (of the query and of the vector's
unread postings), which gives every score a lower and an upper bound. A query stops only when
these prove that few vectors can still be among its best; those are scored again exactly.

Queries come in blocks, and every block meets every shard once, so work is the number of
queries times the number of vectors at most, spread over (block, shard) tasks.

Edge cases: a vector that is null or has a null or non-finite component, or a null id, takes
no part; of vectors of unlike length the missing components count as zero; rows that share
the query's id are its own rows and no candidates; other repeated rows are candidates each,
and a query row that is repeated gets a list for each of its rows; no rows give no lists; ties go
to the smaller id; scores are 64-bit and wrap beyond; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.shared import settled
from auditloom.llm.words import groups

SHARD, QUERIES, BATCH = 16_384, 2_048, 128
#: Shares of a shard's postings with a smaller impact than a segment's.
SEGMENTS = (0.75, 0.5, 0.3, 0.15, 0.0)
#: A query stops when no more than this share of a shard can still be among its best.
FEW = 0.03


def _whole_numbers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """Ids and components floor(scale * x) of the vectors that take part, and a number for each row."""
    x = F.col(f"`{vector_col}`")
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    numbers = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return vectors.filter(usable & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), numbers.alias("v"), F.monotonically_increasing_id().alias("row")
    )


def _blocks(vectors: DataFrame, count: int, name: str) -> DataFrame:
    """Vectors dealt into ``count`` blocks by hash, one row each: ids, row numbers, numbers, dimensions."""

    def run(batches):
        for table in groups(batches, name):
            lists = table.column("v").combine_chunks()
            sizes = np.diff(np.asarray(lists.offsets))
            dims = int(sizes.max())
            matrix = np.zeros((len(sizes), dims), np.int64)
            matrix[np.arange(dims) < sizes[:, None]] = np.asarray(lists.flatten())
            if matrix.size and np.abs(matrix).max() < 1 << 15:
                matrix = matrix.astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([table.column(name)[0].as_py()], pa.int64()),
                    pa.array([np.asarray(table.column("id")).tobytes()]),
                    pa.array([np.asarray(table.column("row")).tobytes()]),
                    pa.array([matrix.tobytes()]),
                    pa.array([dims], pa.int32()),
                ],
                [name, f"{name}_ids", f"{name}_rows", f"{name}_numbers", f"{name}_dims"],
            )

    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(count)))
    return dealt.repartition(name).sortWithinPartitions(name, "row").mapInArrow(
        run, f"{name} long, {name}_ids binary, {name}_rows binary, {name}_numbers binary, {name}_dims int"
    )


def _unpacked(ids: bytes, numbers: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(numbers) == 2 * len(keys) * dims else np.int64
    return keys, np.frombuffer(numbers, kind).reshape(len(keys), dims)


class Shard:
    """Vectors with their postings in segments of descending impact."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray):
        self.ids, self.numbers = ids, numbers
        impact = np.abs(numbers.astype(np.float32))
        self.norms = np.sqrt(np.square(impact, dtype=np.float64).sum(1))
        cuts = [float(np.quantile(impact, s)) if impact.size else 0.0 for s in SEGMENTS[:-1]]
        upper, self.segments, self.unread = np.inf, [], []
        for low in [*dict.fromkeys(cuts), -1.0]:
            self.segments.append(np.where((impact < upper) & (impact >= low), numbers, 0).astype(np.float32).T.copy())
            self.unread.append(np.sqrt(np.square(np.where(impact < low, impact, 0), dtype=np.float64).sum(1)))
            upper = low

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Per query: its number, and ids and scores of its ``k`` best here."""
        dims = min(queries.shape[1], self.numbers.shape[1])
        q = queries[:, :dims].astype(np.float32)
        norms = np.sqrt(np.square(queries, dtype=np.float64).sum(1))
        rounding = (dims + 4) * 1.2e-7 * self.norms
        scores, going = np.zeros((len(q), len(self.ids)), np.float32), np.arange(len(q))
        few = max(4 * k, int(FEW * len(self.ids)))
        for segment, unread in zip(self.segments, self.unread, strict=True):
            scores[going] += q[going] @ segment[:dims]
            left = []
            for i in going.tolist():
                slack = (norms[i] * (unread + rounding)).astype(np.float32) + np.float32(1e-3)
                low, high = scores[i] - slack, scores[i] + slack
                low[self.ids == query_ids[i]] = -np.inf
                floor = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                possible = np.flatnonzero(high >= floor)
                if len(possible) > few and segment is not self.segments[-1]:
                    left.append(i)
                    continue
                possible = possible[self.ids[possible] != query_ids[i]]
                exact = self.numbers[possible, :dims].astype(np.int64) @ queries[i, :dims].astype(np.int64)
                top = np.lexsort((self.ids[possible], -exact))[:k]
                yield i, self.ids[possible][top], exact[top]
            going = np.array(left, np.int64)
            if not left:
                return


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    queries: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` best of each query.

    ``is_query`` is a condition on the column ``id``.
    """
    numbers = settled(_whole_numbers(vectors, scale, id_col, vector_col))
    n, n_queries = numbers.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_queries // queries))
    index = _blocks(numbers, shards, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = _blocks(numbers.filter(is_query), blocks, "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                here = Shard(*_unpacked(row["shard_ids"], row["shard_numbers"], row["shard_dims"]))
                ids, numbers = _unpacked(row["block_ids"], row["block_numbers"], row["block_dims"])
                rows = np.frombuffer(row["block_rows"], np.int64)
                for at in range(0, len(ids), BATCH):
                    some = ids[at : at + BATCH]
                    found = list(here.best(some, numbers[at : at + BATCH], k))
                    sizes, which = [len(f[1]) for f in found], [f[0] for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(rows[at : at + BATCH][which], sizes), pa.int64()),
                            pa.array(np.repeat(some[which], sizes), pa.int64()),
                            *(pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in (1, 2)),
                        ],
                        ["query_row", "query_id", "vec_id", "score"],
                    )

    found = index.join(asked.hint("shuffle_hash"), ["shard", "block"]).mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
