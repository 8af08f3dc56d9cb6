"""Feed-forward networks (T2) fitted on Spark: the tasks take gradients with numpy, Spark adds them, L-BFGS steps.

The network is the one of Spark's ``MultilayerPerceptronClassifier`` (sigmoid hidden units, softmax output,
cross-entropy, its order of weights), as is the solver (L-BFGS of 10 corrections, strong Wolfe steps, its tolerance). An
evaluation is one job over the cached rows, packed as matrices: a block of rows is a few matrix products, a partition gives
one sum, the sums are added in groups, and the driver gets ``FEW_SUMS`` gradients at most or the square root of the
partitions. Rows may carry weights, which Spark's class does not take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024  # rows of one matrix product: many, as calls and sums cost by the block, but their activations stay in the cache
PACK_BYTES = 4 << 20  # features of one packed row, at most (one row's features if they are more)
FEW_SUMS = 32  # gradients the driver adds itself
PACKED = "x binary, y binary, w binary"
SUMS = "part long, weight double, loss double, gradient binary"


def layer_views(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix of inputs × outputs, bias) of each layer: views into ``weights``, in the order Spark's model keeps them."""
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


class GradientSum:
    """Weighted sums of loss and gradient over rows, added block by block.

    Features, logits, losses and all sums are doubles; only the hidden units of a block and the products between them
    are in single precision, whose rounding is independent from row to row and averages out in the sums. Hidden layers
    are kept with the sign turned, as their units 1 / (1 + exp(-z)) want -z."""

    def __init__(self, weights: np.ndarray, layers: Sequence[int]):
        *hidden, self.out = layer_views(weights, layers)
        self.first = -np.vstack(hidden[0]) if hidden else None
        self.inner = [((-m).astype(np.float32), b.astype(np.float32)) for m, b in hidden[1:]]
        self.gradient = np.zeros(len(weights))
        self.sums = layer_views(self.gradient, layers)
        # buffers of a block, kept: fresh ones of this size cost as much as the products
        self.wide = np.empty((BLOCK_ROWS, layers[1])) if hidden else None
        self.values, self.deltas = ([np.empty((BLOCK_ROWS, n), np.float32) for n in layers[1:-1]] for _ in range(2))
        self.products = [np.empty_like(m) for m, _ in self.inner]
        self.ones = np.ones(BLOCK_ROWS, np.float32)
        self.weight = self.loss = 0.0

    def add(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        x = np.column_stack([x, np.ones(len(x))])  # the first layer's bias is the weight of a 1
        with np.errstate(over="ignore"):
            for i in range(0, len(x), BLOCK_ROWS):
                self._block(x[i:i + BLOCK_ROWS], y[i:i + BLOCK_ROWS], w[i:i + BLOCK_ROWS])

    def _block(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        values = [v[:len(x)] for v in self.values]
        for k, z in enumerate(values):
            if k == 0:
                z[:] = np.matmul(x, self.first, out=self.wide[:len(x)])
            else:
                matrix, bias = self.inner[k - 1]
                np.matmul(values[k - 1], matrix, out=z)
                z -= bias
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        last = values[-1].astype(float) if values else x[:, :-1]
        delta = self._output(last, y, w)
        if not values:
            return
        below = self.deltas[-1][:len(x)]
        below[:] = delta.T @ self.out[0].T
        for k in range(len(values) - 1, -1, -1):
            a, (matrix_sum, bias_sum) = values[k], self.sums[k]
            below *= a  # times the slope a (1 - a)
            if k == len(values) - 1:
                np.subtract(1, a, out=a)
            else:  # what came through a hidden layer has the turned sign
                np.subtract(a, 1, out=a)
            below *= a
            if k == 0:
                wide = self.wide[:len(x)]
                wide[:] = below
                total = x.T @ wide
                matrix_sum += total[:-1]
                bias_sum += total[-1]
            else:
                matrix_sum += np.matmul(values[k - 1].T, below, out=self.products[k - 1])
                bias_sum += self.ones[:len(x)] @ below
                below = np.matmul(below, self.inner[k - 1][0].T, out=self.deltas[k - 1][:len(x)])

    def _output(self, a: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Adds the loss and the last layer's sums; the loss's slopes at the logits, one row per class."""
        (matrix, bias), (matrix_sum, bias_sum), rows = self.out, self.sums[-1], np.arange(len(a))
        z = matrix.T @ a.T
        z += bias[:, None]
        z -= z.max(axis=0)
        delta = np.exp(z)
        total = delta.sum(axis=0)
        self.weight += float(w.sum())
        self.loss += float(w @ (np.log(total) - z[y, rows]))
        delta /= total
        delta[y, rows] -= 1.0
        delta *= w
        matrix_sum += a.T @ delta.T
        bias_sum += delta.sum(axis=1)
        return delta


def _sums_table(part: int, weight: float, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([weight], pa.float64()), pa.array([loss], pa.float64()),
                                       pa.array([gradient.tobytes()], pa.binary())], names=["part", "weight", "loss", "gradient"])


def _packed(classes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *x, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.stack(x, axis=1).astype(float)
            if not np.isfinite(x).all():
                raise ValueError("features of a network must be finite")
            if not np.isin(y, np.arange(classes)).all():
                raise ValueError(f"labels of a network must be whole numbers from 0 to {classes - 1}")
            y, w, step = y.astype(np.int64), w.astype(float), max(1, PACK_BYTES // (8 * x.shape[1]))
            for i in range(0, len(x), step):
                yield pa.RecordBatch.from_arrays([pa.array([v[i:i + step].tobytes()], pa.binary()) for v in (x, y, w)],
                                                 names=["x", "y", "w"])
    return pack


def packed_rows(rows: DataFrame, layers: Sequence[int]) -> DataFrame:
    """``rows`` (feature columns, label, row weight) checked and packed, a batch of them per row, in their partitions: a
    pass hands the tasks their matrices as they are instead of turning every row into columns again."""
    return rows.mapInArrow(_packed(layers[-1]), PACKED)


def _partition_sums(weights: np.ndarray, layers: Sequence[int]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = GradientSum(weights, layers)
        for batch in batches:
            for x, y, w in zip(*batch.columns):
                x, y, w = np.frombuffer(x.as_buffer()), np.frombuffer(y.as_buffer(), np.int64), np.frombuffer(w.as_buffer())
                total.add(x.reshape(len(y), layers[0]), y, w)
        yield _sums_table(TaskContext.get().partitionId(), total.weight, total.loss, total.gradient)
    return sums


def _add_sums(table: pa.Table) -> pa.Table:
    """The sums of a group of partitions in the order of their numbers, so that a repeated run adds alike."""
    weight, loss, gradient, table = 0.0, 0.0, 0.0, table.sort_by("part")
    for r in range(table.num_rows):
        weight, loss = weight + table["weight"][r].as_py(), loss + table["loss"][r].as_py()
        gradient = gradient + np.frombuffer(table["gradient"][r].as_py())
    return pa.Table.from_batches([_sums_table(table["part"][0].as_py(), weight, loss, gradient)])


def mean_loss(rows: DataFrame, layers: Sequence[int]) -> Callable:
    """``weights -> (weighted mean loss, its gradient)`` over ``rows``: the feature columns, the label, the row weight."""
    return packed_loss(packed_rows(rows, layers), layers)


def packed_loss(rows: DataFrame, layers: Sequence[int]) -> Callable:
    """:func:`mean_loss` of rows that :func:`packed_rows` has packed."""
    parts = rows.rdd.getNumPartitions()

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sums = rows.mapInArrow(_partition_sums(weights, layers), SUMS)
        if parts > FEW_SUMS:
            sums = sums.groupBy(F.col("part") % ceil(sqrt(parts))).applyInArrow(_add_sums, SUMS)
        sums = sorted(sums.collect(), key=lambda r: r.part)  # gradients, no rows
        weight = sum(r.weight for r in sums)
        if not weight > 0:
            raise ValueError("a network needs training rows")
        return sum(r.loss for r in sums) / weight, sum(np.frombuffer(r.gradient) for r in sums) / weight
    return at


class _NoStep(Exception):
    """No step along a direction lowers the loss enough."""


def _wolfe_step(loss: Callable, x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, t: float) -> tuple:
    """(weights, loss, gradient) at a step that meets the strong Wolfe conditions (Nocedal and Wright, 3.5 and 3.6)."""
    slope = float(gradient @ direction)
    if not slope <= 0:
        raise _NoStep

    def point(t: float) -> tuple:
        at = x + t * direction
        v, g = loss(at)
        return t, v, float(g @ direction), (at, v, g)

    def between(a: tuple, b: tuple) -> float:
        (lt, lv, ls, _), (rt, rv, rs, _) = sorted((a, b), key=lambda p: p[0])
        d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
        d2 = np.sqrt(max(d1 * d1 - ls * rs, 0.0))
        return float(np.clip(rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2), lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)))

    def zoom(low: tuple, high: tuple) -> tuple:
        for _ in range(10):
            c = point(between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _NoStep

    low = (0.0, value, slope, None)
    for i in range(10):
        c = point(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)[3]
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[3]
        if c[2] >= 0:
            return zoom(c, low)[3]
        low, t = c, t * 1.5
    raise _NoStep


def lbfgs(loss: Callable, x: np.ndarray, max_iter: int, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Weights after at most ``max_iter`` steps of L-BFGS from ``x``.

    It ends earlier when the loss is within ``tolerance`` (times the first loss) of the largest of its last 20 values,
    when the gradient is that small against the loss, or when no step is found, also not along the plain gradient."""
    value, gradient = loss(x)
    first, values, pairs, failed = value, [value], [], False
    for i in range(max_iter):
        if np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        direction, factors = gradient.copy(), []
        for s, y in reversed(pairs):
            factors.append((s @ direction) / (s @ y))
            direction -= factors[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), factor in zip(pairs, reversed(factors)):
            direction += (factor - (y @ direction) / (s @ y)) * s
        direction = -direction
        try:
            new = _wolfe_step(loss, x, value, gradient, direction, 1.0 if i else 1.0 / np.linalg.norm(direction))
        except _NoStep:
            if failed or not pairs:
                break
            failed, pairs = True, []
            continue
        failed = False
        step, change = new[0] - x, new[2] - gradient
        x, value, gradient = new
        pairs = [*pairs, (step, change)][-memory:] if step @ change > 0 else []
        values = [*values, value][-20:]
        if abs(value - max(values)) <= tolerance * abs(first):
            break
    return x


def fit_weights(rows: DataFrame, layers: Sequence[int], start: np.ndarray, max_iter: int) -> np.ndarray:
    """The weights of a network fitted to ``rows`` (feature columns, label, row weight, in this order) from ``start``."""
    rows = packed_rows(rows, layers).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return lbfgs(packed_loss(rows, layers), start, max_iter)
    finally:
        rows.unpersist()
