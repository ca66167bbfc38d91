"""Gaussian kernels by random Fourier features, and probabilities by Platt's calibration.

A kernel machine needs all pairs of rows; its kernel is therefore replaced by the inner product
of random cosines, whose mean is the Gaussian kernel. The cosines are drawn from a seed, so
every task makes the same ones, and a linear machine is trained over them: hinge loss and a
squared norm over standardised cosines, as Spark's ``LinearSVC`` has them. The cosines of a row
are many times larger than its features, so that they are never held: the features are settled
once in blocks, and each pass over them makes the cosines of a piece anew, in single precision.

Edge cases: a feature without variation counts as zero; calibration without held-out rows is
the plain logistic function of the decision; a class without held-out rows gets Platt's prior.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import settled

COMPONENTS = 256
#: Share of the training rows that calibrate, and are kept from fitting.
CALIBRATION_SHARE = 0.2
#: Bytes of cosines that one task of a training pass makes at most, about; a piece of them is held at a time.
TASK_BYTES = 1 << 29
#: Rows of a settled block, and single numbers that a piece holds as cosines and decisions: what a core's cache holds.
BLOCK_ROWS, PIECE_CELLS = 8_192, 1 << 17
#: The angle up to which single precision gives a cosine to five digits.
MOST_ANGLE = 100.0
#: Steps along a direction that a pass tries, and by how much they shrink if none of them is good.
STEPS, SHRINK = (1.0, 0.5, 0.25, 2.0), 0.05
#: Steps that are remembered, and the change of loss (relative, over as many steps) that ends the training.
MEMORY, TOLERANCE = 10, 1e-6
#: Tasks whose sums the driver adds by itself.
MOST_SUMS = 1_024

# The small functions below travel with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class GaussianFeatures:
    """``exp(-gamma |x - y|^2)`` over standardised features as an inner product of cosines."""

    def __init__(self, train: DataFrame, features: str, seed: int, gamma: float | None = None, components: int = COMPONENTS):
        moments = train.select(Summarizer.metrics("mean", "std").summary(F.col(features)).alias("s")).select("s.mean", "s.std").first()
        self.mean, deviation = np.array(moments["mean"]), np.array(moments["std"])
        self.scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
        width = len(self.mean)
        rng = np.random.default_rng(seed)
        gamma = 1.0 / max(width, 1) if gamma is None else gamma
        self.directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, components))
        self.phases = rng.uniform(0.0, 2.0 * np.pi, components)

    def transform(self, df: DataFrame, features: str, out: str) -> DataFrame:
        mean, scale, directions, phases = self.mean, self.scale, self.directions, self.phases
        size = np.sqrt(2.0 / len(phases))

        @F.pandas_udf("array<double>")
        def cosines(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(size * np.cos((np.stack(x.to_list()) - mean) * scale @ directions + phases)))

        return df.withColumn(out, array_to_vector(cosines(vector_to_array(features))))

    def piece(self):
        """A function that makes the cosines of some rows, in single precision."""
        mean, scale, directions, phases = self.mean, self.scale, self.directions, self.phases
        single = np.vstack([directions, phases]).astype(np.float32)
        reach = np.abs(directions).sum(0).max(initial=0.0)
        size = np.float32(np.sqrt(2.0 / len(phases)))

        def cosines(x: np.ndarray) -> np.ndarray:
            x = (x - mean) * scale
            if np.abs(x).max(initial=0.0) * reach < MOST_ANGLE:
                angles = np.column_stack([x, np.ones(len(x))]).astype(np.float32) @ single
            else:  # whole turns are taken off in double precision
                turns = (x @ directions + phases) / (2.0 * np.pi)
                angles = (turns - np.rint(turns)).astype(np.float32) * np.float32(2.0 * np.pi)
            np.cos(angles, out=angles)
            angles *= size
            return angles

        return cosines


class KernelMachine:
    """A linear machine over the cosines, for two classes or each class against the rest."""

    def __init__(self, kernel: GaussianFeatures, weights: np.ndarray, offsets: np.ndarray, n_classes: int):
        self.kernel, self.weights, self.offsets, self.n_classes = kernel, weights, offsets, n_classes

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``rawPrediction``, a value for each class, and ``prediction``."""
        cosines, weights, offsets = self.kernel.piece(), self.weights.astype(np.float32), self.offsets
        rows = _piece_rows(*weights.shape)

        @F.pandas_udf("array<double>")
        def decide(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            x = np.stack(x.to_list())
            return pd.Series(list(np.concatenate([cosines(x[at : at + rows]) @ weights + offsets for at in range(0, len(x), rows)])))

        decided = df.withColumn("__raw", decide(vector_to_array(features)))
        value = F.get("__raw", F.lit(0))
        if self.n_classes <= 2:
            raw, prediction = F.array(-value, value), (~F.isnan(value) & (value > 0)).cast("double")
        else:
            raw, prediction = F.col("__raw"), (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")
        return decided.withColumns({"rawPrediction": array_to_vector(raw), "prediction": prediction}).drop("__raw")


def fit_machine(
    kernel: GaussianFeatures, train: DataFrame, n_classes: int, reg: float, max_iter: int,
    features: str = "features", label: str = "label", weight: str | None = None,
) -> KernelMachine:
    """The machine of least hinge loss plus ``reg`` / 2 times the squared norm over standardised cosines.

    The rows' features are settled in blocks; a pass over them tries some steps for all classes at
    once (limited-memory BFGS), so that an iteration is one pass as a rule.
    """
    blocks = settled(spread(_packed(train, features, label, weight), len(kernel.phases), n_rows=train.count()))
    classes = np.array([1] if n_classes <= 2 else range(n_classes))
    total, squares, first, second = _moments(blocks, kernel)
    if not total > 0:
        raise ValueError("a kernel machine needs training rows whose weights are not all zero")
    mean = first / total
    spare = total - squares / total
    variance = np.maximum(second - total * mean * mean, 0.0) / spare if spare > 0 else np.zeros_like(mean)
    variance[variance <= 1e-12 * (second / total)] = 0.0
    scale = np.divide(1.0, np.sqrt(variance), out=np.zeros_like(variance), where=variance > 0)

    def losses(points: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses and gradients at each row of ``points`` (the weights and the offset) for the class in ``of``."""
        plain = points[:, :-1] * scale
        loss, pull, sums = _hinge(blocks, kernel, plain.T, points[:, -1] - plain @ mean, of)
        gradients = np.column_stack([(sums.T - np.outer(pull, mean)) * scale, pull]) / total
        gradients[:, :-1] += reg * points[:, :-1]
        return loss / total + reg / 2 * (points[:, :-1] ** 2).sum(1), gradients

    points = _least(losses, classes, len(mean) + 1, max_iter)
    weights = points[:, :-1] * scale
    return KernelMachine(kernel, weights.T, points[:, -1] - weights @ mean, n_classes)


def _least(losses, classes: np.ndarray, width: int, max_iter: int) -> np.ndarray:
    """The points of least loss, one for each class, by limited-memory BFGS with several steps to a pass."""
    points = np.zeros((len(classes), width))
    loss, gradients = losses(points, classes)
    steps: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in classes]
    history = [[x] for x in loss]
    open_classes = [c for c in range(len(classes)) if np.abs(gradients[c]).max() > 0]
    shrunk = np.ones(len(classes))
    for _ in range(max_iter):
        if not open_classes:
            break
        ways = {c: _direction(gradients[c], steps[c]) for c in open_classes}
        tried = [(c, shrunk[c] * t) for c in open_classes for t in STEPS]
        found, slopes = losses(np.stack([points[c] + t * ways[c] for c, t in tried]), classes[[c for c, _ in tried]])
        left = []
        for c in open_classes:
            mine = [k for k, (of, t) in enumerate(tried) if of == c and found[k] <= loss[c] + 1e-4 * t * (gradients[c] @ ways[c])]
            if not mine:
                if steps[c]:  # the curvature misleads: on with the steepest descent
                    steps[c] = []
                    left.append(c)
                elif shrunk[c] > 1e-9:
                    shrunk[c] *= SHRINK
                    left.append(c)
                continue
            best = min(mine, key=lambda k: found[k])
            step, change = tried[best][1] * ways[c], slopes[best] - gradients[c]
            if step @ change > 1e-12 * np.sqrt((step @ step) * (change @ change)):
                steps[c] = [*steps[c][1 - MEMORY :], (step, change)]
            points[c], loss[c], gradients[c], shrunk[c] = points[c] + step, found[best], slopes[best], 1.0
            history[c] = [*history[c][-MEMORY:], loss[c]]
            settled_down = len(history[c]) > MEMORY and history[c][0] - loss[c] <= TOLERANCE * abs(loss[c])
            if not settled_down and np.sqrt((gradients[c] ** 2).sum()) > TOLERANCE * max(abs(loss[c]), 1e-9):
                left.append(c)
        open_classes = left
    return points


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the curvature of the last steps; without any, a step of length one."""
    if not steps:
        return -gradient / max(np.sqrt(gradient @ gradient), 1e-300)
    way, shares = -gradient, []
    for step, change in reversed(steps):
        shares.append((step @ way) / (step @ change))
        way = way - shares[-1] * change
    step, change = steps[-1]
    way = way * ((step @ change) / (change @ change))
    for (step, change), share in zip(steps, reversed(shares), strict=True):
        way = way + step * (share - (change @ way) / (step @ change))
    return way


def _piece_rows(components: int, columns: int) -> int:
    return max(1, PIECE_CELLS // (components + columns))


def _packed(train: DataFrame, features: str, label: str, weight: str | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows: how many, and their features, codes and weights as bytes."""
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("code"), given.alias("given"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                w = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                if not (np.isfinite(w) & (w >= 0)).all():
                    raise ValueError("weights must not be null, NaN, infinite or negative")
                x = part.column(0).flatten().to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    raise ValueError("features must not be NaN or infinite")
                codes = part.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
                same = weight is None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.num_rows]), *(pa.array([b], pa.binary()) for b in (x.tobytes(), codes.tobytes(), b"" if same else w.tobytes()))],
                    ["n", "x", "codes", "given"],
                )

    return rows.mapInArrow(pack, "n bigint, x binary, codes binary, given binary")


def _pieces(batches, kernel_piece, rows: int):
    """(cosines, codes, weights) of the rows of some blocks, a piece at a time."""
    for batch in batches:
        for n, x, codes, given in zip(*(batch.column(c) for c in range(4)), strict=True):
            n = n.as_py()
            x = np.frombuffer(x.as_buffer())
            x = x.reshape(n, len(x) // n)
            codes = np.frombuffer(codes.as_buffer(), np.int32)
            given = np.frombuffer(given.as_buffer()) if len(given.as_buffer()) else np.ones(n)
            for at in range(0, n, rows):
                part = slice(at, at + rows)
                yield kernel_piece(x[part]), codes[part], given[part]


def _summed(blocks: DataFrame, sums_of) -> np.ndarray:
    """The sum over all tasks of an array that ``sums_of`` makes of a task's blocks."""

    def bytes_of(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def run(batches):
        total = sums_of(batches)
        if total is not None:
            yield bytes_of(total)

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                x = np.frombuffer(x.as_buffer())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield bytes_of(total)

    found = blocks.mapInArrow(run, "sums binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > MOST_SUMS:
        found = found.repartition(math.isqrt(tasks)).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in found.collect()), np.zeros(1))


def _moments(blocks: DataFrame, kernel: GaussianFeatures) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The sum of the weights and of their squares, and the weighted sums of the cosines and of their squares."""
    cosines, width = kernel.piece(), len(kernel.phases)

    def sums_of(batches):
        total = None
        for z, _, given in _pieces(batches, cosines, _piece_rows(width, 1)):
            z = z.astype(float)
            part = np.concatenate([[given.sum(), given @ given], given @ z, given @ (z * z)])
            total = part if total is None else total + part
        return total

    total = _summed(blocks, sums_of)
    total = np.zeros(2 + 2 * width) if len(total) == 1 else total
    return total[0], total[1], total[2 : 2 + width], total[2 + width :]


def _hinge(blocks: DataFrame, kernel: GaussianFeatures, weights: np.ndarray, offsets: np.ndarray, of: np.ndarray):
    """For each column of ``weights``: the hinge loss against its class, and the sums of its slope and of slope times cosine."""
    cosines, (width, columns) = kernel.piece(), weights.shape
    single, offsets = weights.astype(np.float32), offsets.astype(np.float32)

    def sums_of(batches):
        total = None
        for z, codes, given in _pieces(batches, cosines, _piece_rows(width, columns)):
            sign = np.where(codes[:, None] == of, np.float32(1), np.float32(-1))
            short = 1 - sign * (z @ single + offsets)
            pull = np.where(short > 0, -sign, np.float32(0)) * given.astype(np.float32)[:, None]
            part = np.concatenate([given @ np.maximum(short, 0), pull.sum(0, dtype=float), (z.T @ pull).ravel()])
            total = part if total is None else total + part
        return total

    total = _summed(blocks, sums_of)
    return total[:columns], total[columns : 2 * columns], total[2 * columns :].reshape(width, columns)


def spread(train: DataFrame, components: int = COMPONENTS, task_bytes: int = TASK_BYTES, n_rows: int | None = None) -> DataFrame:
    """The rows dealt to as many tasks as their cosines need; ``n_rows`` if the rows are blocks of so many."""
    n_rows = train.count() if n_rows is None else n_rows
    tasks = -(-n_rows * components * 8 // task_bytes)
    return train if tasks <= 1 else train.repartition(max(tasks, train.sparkSession.sparkContext.defaultParallelism))


def decisions(n_classes: int, raw: str = "rawPrediction") -> list[Column]:
    """The decision value for each class; of two classes only that for the second."""
    values = vector_to_array(raw)
    return [F.get(values, F.lit(1))] if n_classes == 2 else [F.get(values, F.lit(c)) for c in range(n_classes)]


def platt(scored: DataFrame, label: str, n_classes: int, weight: str | None = None, raw: str = "rawPrediction") -> list[tuple[float, float]]:
    """Slope and offset of a logistic function of each decision value, fitted on held-out rows.

    As Platt proposes, a row of the class counts as (n+1)/(n+2) of it and any other as 1/(m+2),
    so that a perfect separation does not make the slope infinite.
    """
    found = []
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    classes = [1] if n_classes == 2 else range(n_classes)
    for c, value in zip(classes, decisions(n_classes, raw)):
        rows = scored.select(value.alias("x"), (F.col(label) == c).alias("is"), given.alias("given")).persist()
        n, m = rows.agg(F.count_if("is"), F.count_if(~F.col("is"))).first()
        if n + m == 0:
            found.append((1.0, 0.0))
        else:
            share = F.when(F.col("is"), F.lit((n + 1) / (n + 2))).otherwise(F.lit(1 / (m + 2)))
            both = rows.select(
                array_to_vector(F.array("x")).alias("features"),
                F.inline(F.array(
                    F.struct(F.lit(1.0).alias("label"), (share * F.col("given")).alias("weight")),
                    F.struct(F.lit(0.0).alias("label"), ((1 - share) * F.col("given")).alias("weight")),
                )),
            )
            fitted = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=50).fit(both)
            found.append((float(fitted.coefficients[0]), float(fitted.intercept)))
        rows.unpersist()
    return found


def probabilities(calibration: list[tuple[float, float]], n_classes: int, raw: str = "rawPrediction") -> Column:
    """An array with the probability of every class; of more than two they are scaled to sum to one."""
    each = [1.0 / (1.0 + F.exp(-(F.lit(a) * x + F.lit(b)))) for (a, b), x in zip(calibration, decisions(n_classes, raw))]
    if n_classes == 2:
        return F.array(1.0 - each[0], each[0])
    total = F.greatest(sum(each[1:], each[0]), F.lit(1e-300))
    return F.array(*[p / total for p in each])
