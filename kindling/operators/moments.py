"""Mergeable moments of wide tables: counts, means, squared deviations and co-moments with a label, all columns at once.

A task turns each Arrow batch into a (rows, columns) matrix and reduces it to a few vectors as long as the feature
list; the vectors of batches, tasks and groups of tasks are merged pairwise, which is exact algebra and stays accurate
where sums of squares do not. The table is read once, nothing is stacked into rows × features, and a task sends one
row. The rows of a table of more than ``LARGE`` bytes (by the plan's estimate) are merged in two steps, so the last task
sees one row per partition of the first step, not per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.functions.columns import sql_ident

#: per feature: all rows, known rows, mean, squared deviations, least, greatest, and over the rows where the label is
#: known too: rows, both means, both squared deviations and the co-moment
PARTS = ("rows", "n", "mean", "m2", "min", "max", "n_xy", "mean_x", "mean_y", "m2_x", "m2_y", "c_xy")
_SCHEMA = "a array<double>"
LARGE = 1 << 40  # about 8,000 tasks


def _of_batch(x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """The vectors of one matrix (a row per entry of ``PARTS``). NaN marks a missing value."""
    known = ~np.isnan(x)
    n = known.sum(axis=0).astype(float)
    some = np.maximum(n, 1)
    columns = np.arange(x.shape[1])

    def centred(value: np.ndarray, where: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations; counted from the first value, so that a constant column deviates by exactly 0."""
        origin = np.where(where.any(axis=0), value[where.argmax(axis=0), columns], 0.0)
        off = np.where(where, value - origin, 0.0)
        mean = off.sum(axis=0) / count
        return origin + mean, np.where(where, off - mean, 0.0)

    mean, off = centred(x, known, some)
    out = np.zeros((len(PARTS), x.shape[1]))
    out[0], out[1], out[2], out[3] = len(x), n, mean, (off * off).sum(axis=0)
    out[4] = np.where(known, x, np.inf).min(axis=0, initial=np.inf)
    out[5] = np.where(known, x, -np.inf).max(axis=0, initial=-np.inf)
    if y is not None:
        both = known & ~np.isnan(y)[:, None]
        m = both.sum(axis=0).astype(float)
        one = np.maximum(m, 1)
        (mx, dx), (my, dy) = centred(x, both, one), centred(np.broadcast_to(y[:, None], x.shape), both, one)
        out[6], out[7], out[8] = m, mx, my
        out[9], out[10], out[11] = (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The vectors of two disjoint sets of rows taken together."""
    out = a + b
    with np.errstate(invalid="ignore"):
        n = np.maximum(out[1], 1)
        d = b[2] - a[2]
        out[2] = np.where(a[1] == 0, b[2], np.where(b[1] == 0, a[2], a[2] + d * b[1] / n))
        out[3] = a[3] + b[3] + np.where((a[1] > 0) & (b[1] > 0), d * d * a[1] * b[1] / n, 0.0)
        out[4], out[5] = np.minimum(a[4], b[4]), np.maximum(a[5], b[5])
        m = np.maximum(out[6], 1)
        meet = (a[6] > 0) & (b[6] > 0)
        dx, dy, w = b[7] - a[7], b[8] - a[8], a[6] * b[6] / m
        for k, step in ((7, dx), (8, dy)):
            out[k] = np.where(a[6] == 0, b[k], np.where(b[6] == 0, a[k], a[k] + step * b[6] / m))
        for k, product in ((9, dx * dx), (10, dy * dy), (11, dx * dy)):
            out[k] = a[k] + b[k] + np.where(meet, product * w, 0.0)
    return out


def _reduce(width: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            part = _of_batch(x[:, :width], x[:, width] if x.shape[1] > width else None)
            total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["a"])
    return reduce


def _merge_rows(width: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).flatten().to_numpy().reshape(-1, len(PARTS), width):
                total = row if total is None else merge(total, row)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["a"])
    return reduce


def moments(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """One row per feature, in the given order: ``(place, feature, rows, n, mean, m2, min, max, n_xy, mean_x, mean_y, m2_x,
    m2_y, c_xy)``.

    Null and NaN count as missing. ``n``, ``mean`` and ``m2`` (sum of squared deviations), ``min`` and ``max`` are over the
    known values; the rest is over the rows in which ``label`` is known too. A feature without values has null mean and
    bounds. An empty table gives a row of zeros per feature. Columns of other names are not read.
    """
    features = list(features)
    spark, width = df.sparkSession, len(features)
    if width == 0:
        raise ValueError("no features")
    # one list column without nulls: its buffer is the matrix
    values = ", ".join(f"coalesce(CAST({sql_ident(c)} AS DOUBLE), double('NaN'))" for c in [*features, *([label] if label else [])])
    parts = df.selectExpr(f"array({values}) AS v").mapInArrow(_reduce(width), _SCHEMA)
    # a row per task; those of a large table are merged in parallel first (AQE makes partitions of a bounded size)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > LARGE:
        parts = parts.repartition(F.xxhash64("a")).mapInArrow(_merge_rows(width), _SCHEMA)
    parts = parts.repartition(1).mapInArrow(_merge_rows(width), _SCHEMA)
    value = lambda k: F.get("a", F.lit(k * width) + F.col("place")).alias(PARTS[k])
    found = parts.select("a", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("place"))
    found = found.select("place", *[value(k) for k in range(len(PARTS))])
    places = spark.range(0, width, 1, 1).select(F.col("id").cast("int").alias("place"))
    names = places.select("place", F.get(F.array(*[F.lit(f) for f in features]), F.col("place")).alias("feature"))
    return _filled(names.join(F.broadcast(found), "place", "left"))  # a row per feature


def _filled(out: DataFrame) -> DataFrame:
    """Counts as whole numbers, and the rule for features without values."""
    known, none = F.col("n") > 0, F.lit(None).cast("double")
    out = out.withColumns({p: F.coalesce(F.col(p), F.lit(0.0)).cast("long") for p in ("rows", "n", "n_xy")})
    return out.withColumns({p: F.when(known, F.col(p)).otherwise(none) for p in ("mean", "min", "max")}).withColumns(
        {p: F.coalesce(F.col(p), F.lit(0.0)) for p in ("m2", "mean_x", "mean_y", "m2_x", "m2_y", "c_xy")})

