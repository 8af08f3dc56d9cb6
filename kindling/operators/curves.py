"""Additive models with continuous shape functions: piecewise linear curves between knots.

A shape function is a value per knot; between knots it is linear, outside them it keeps its end value. So a row's
logit is a sum over hat functions, of which two per feature are not zero: the fit is a logistic regression on sparse
vectors, however many knots there are, and scoring is a binary search per value in one Arrow pass.

Smoothness is a penalty on each bend (the change of slope at an inner knot). It is stated as rows: a row whose vector is
the bend's linear form, once with each label, adds log(1 + e^z) + log(1 + e^-z) to the loss, which is least at z = 0 and
close to z²/4 + 2 log 2. Those few rows ride along with the data through the same distributed fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions.columns import sigmoid, sql_clean_double, sql_ident
from kindling.operators.fit import POS_WEIGHT, class_weight, spread_rows
from kindling.operators.scoring import _share, _valid_rows, by_position, map_vectors

BEND_SCALE = 0.5  # of the penalty rows' vectors: their loss is close to a square up to bends of about 2
QUANTILE_ACCURACY = 10_000  # of the knots: relative rank error 1 / 10,000


@dataclass
class Curves:
    """Ascending knots and one value per knot for each feature, and the bias: the logit of a row whose features are
    all missing (every curve is 0 at 0)."""

    features: list
    knots: list
    shapes: list
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (k, w) in enumerate(zip(self.knots, self.shapes)):
            total += np.interp(x[:, j], k, w)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (a vector, as Spark ML models give it)."""
        p = sigmoid(F.col("_logit"))
        return curve_scores(df, self, "_logit").withColumn("probability", array_to_vector(F.array(1.0 - p, p))).drop("_logit")

    def n_values(self) -> int:
        return sum(len(k) for k in self.knots) + 1


def _matrix_column(df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """The features as one list of doubles; null and NaN count as 0, as in every fit."""
    values = ", ".join(f"coalesce({sql_clean_double(c)}, 0D)" for c in features)
    return df.withColumn(out, F.expr(f"array({values})"))


def curve_scores(df: DataFrame, curves: Curves, out: str = "curve_score") -> DataFrame:
    """The logit ``b + Σ_f g_f(x_f)`` of every row with piecewise linear ``g_f``.

    One narrow Arrow pass over the features as a list. A null or NaN value counts as 0, values beyond the outer knots take the
    end value of the curve; other columns pass through and a column that has the name ``out`` is replaced. An empty
    table gives an empty result."""
    if [k for k in curves.knots if len(k) == 0 or (np.diff(k) <= 0).any()]:
        raise ValueError("knots must ascend, at least one per feature")
    bc = _share(df, curves)
    mapped = map_vectors(_matrix_column(df, curves.features, "_curve_x"), "_curve_x",
                         lambda x: bc.value.logits(x)[:, None], "_curve_y", len(curves.features))
    return mapped.withColumn(out, F.get("_curve_y", F.lit(0))).drop("_curve_x", "_curve_y")


def quantile_knots(df: DataFrame, features: Sequence[str], n_knots: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature (lowest and highest value included), all features in one map-side combined
    aggregate; missing values count as 0. A feature with one value has one knot."""
    if n_knots < 2:
        raise ValueError("a curve needs two knots or more")
    at = ", ".join(f"CAST({i / (n_knots - 1)!r} AS DOUBLE)" for i in range(n_knots))
    row = df.selectExpr(*[f"percentile_approx(coalesce({sql_clean_double(c)}, 0D), array({at}), {QUANTILE_ACCURACY}) AS q{i}"
                          for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [0.0], dtype=np.float64)) for q in row]


def hat_vectors(df: DataFrame, features: Sequence[str], knots: Sequence[np.ndarray], out: str = "_fv") -> DataFrame:
    """``df`` with a sparse vector of the hat functions of all features and, last, a 1: two entries per feature.

    A feature with one knot has one entry of 1."""
    import pyarrow as pa

    starts = np.concatenate([[0], np.cumsum([len(k) for k in knots])]).astype(np.int64)
    size = int(starts[-1]) + 1
    bc = _share(df, [np.asarray(k) for k in knots])
    x_at = len(df.columns)
    keep = [i for i, c in enumerate(df.columns) if c != out]
    schema = T.StructType([df.schema.fields[i] for i in keep] + [T.StructField(out, VectorUDT())])

    def run(batches):
        for rb in batches:
            values, start, _, _ = _valid_rows(rb.column(x_at))
            x = values[start[:, None] + np.arange(len(starts) - 1)]
            n, idx, val = len(x), [], []
            for j, k in enumerate(bc.value):
                if len(k) == 1:
                    idx.append(np.full((n, 1), starts[j]))
                    val.append(np.ones((n, 1)))
                    continue
                lo = np.clip(np.searchsorted(k, x[:, j], side="right") - 1, 0, len(k) - 2)
                t = np.clip((x[:, j] - k[lo]) / (k[lo + 1] - k[lo]), 0.0, 1.0)
                idx.append(starts[j] + np.stack([lo, lo + 1], axis=1))
                val.append(np.stack([1.0 - t, t], axis=1))
            idx = np.concatenate([*idx, np.full((n, 1), size - 1)], axis=1)
            val = np.concatenate([*val, np.ones((n, 1))], axis=1)
            offsets = pa.array((np.arange(n + 1) * idx.shape[1]).astype(np.int32))
            vec = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(idx.astype(np.int32).ravel())),
                 pa.ListArray.from_arrays(offsets, pa.array(val.ravel()))], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in keep] + [vec], names=names)

    names = schema.names
    return by_position(_matrix_column(df, features, "_hat_x")).mapInArrow(run, schema)


def bend_rows(knots: Sequence[np.ndarray]) -> list:
    """The linear forms of the penalty as sparse vectors: for each inner knot the change of slope there, scaled so that its
    largest factor is 2 (a straight line has 0 whatever the spacing), and one row of zeros."""
    size = sum(len(k) for k in knots) + 1
    rows, at = [Vectors.sparse(size, [], [])], 0
    for k in knots:
        for i in range(1, len(k) - 1):
            left, right = 1.0 / (k[i] - k[i - 1]), 1.0 / (k[i + 1] - k[i])
            form = np.array([left, -(left + right), right])
            form *= 2.0 * BEND_SCALE / np.abs(form).max()
            rows.append(Vectors.sparse(size, [at + i - 1, at + i, at + i + 1], form.tolist()))
        at += len(k)
    return rows


def fit_hats(train: DataFrame, features: Sequence[str], knots: Sequence[np.ndarray], label: str = "label",
             pos_weight: float = POS_WEIGHT, smooth: float = 1e-3, max_iter: int = 100) -> LogisticRegressionModel:
    """The class-weighted logistic regression on the hat vectors with the bends' penalty rows.

    The mean loss grows by about ``smooth`` × the sum of squared bends, whatever the number of rows: 0 leaves the curves
    free, a large value makes them straight lines."""
    data = train.select(*features, F.col(label).cast("double").alias("_y"), class_weight(label, pos_weight).alias("_w"))
    data = spread_rows(data, 2 * len(features) + 1, max_iter)
    data = hat_vectors(data, features, knots).select("_y", "_w", "_fv")
    total = train.agg(F.sum(class_weight(label, pos_weight))).first()[0] or 0.0
    weight = max(4.0 * smooth * float(total) / BEND_SCALE ** 2, 1e-9)
    extra = train.sparkSession.createDataFrame([(y, weight, v) for v in bend_rows(knots) for y in (0.0, 1.0)], data.schema)
    lr = LogisticRegression(featuresCol="_fv", labelCol="_y", weightCol="_w", fitIntercept=False, maxIter=max_iter, tol=1e-9)
    return lr.fit(data.unionByName(extra))


def curves_of(model: LogisticRegressionModel, features: Sequence[str], knots: Sequence[np.ndarray]) -> Curves:
    """The fitted curves, each moved to 0 at the value 0; what they are moved by is the bias."""
    w, at, shapes = model.coefficients.toArray(), 0, []
    bias = float(w[-1])
    for k in knots:
        shape = w[at:at + len(k)]
        zero = float(np.interp(0.0, k, shape))
        shapes.append(shape - zero)
        bias += zero
        at += len(k)
    return Curves(list(features), [np.asarray(k) for k in knots], shapes, bias)


def fit_curves(train: DataFrame, features: Sequence[str], label: str = "label", n_knots: int = 10,
               pos_weight: float = POS_WEIGHT, smooth: float = 1e-3, max_iter: int = 100) -> Curves:
    """Additive logistic model with continuous, smoothed shape functions.

    Knots are quantiles of each feature. Missing values count as 0; rows with a missing label must be filtered by the
    caller, as in the other fits. The driver holds one value per knot."""
    features = list(features)
    knots = quantile_knots(train, features, n_knots)
    return curves_of(fit_hats(train, features, knots, label, pos_weight, smooth, max_iter), features, knots)


def curve_table(spark, curves: Curves) -> DataFrame:
    """The curves as rows ``(feature, knot, x, value)``: the data of a shape-function plot."""
    rows = [(f, i, float(x), float(v)) for f, k, w in zip(curves.features, curves.knots, curves.shapes)
            for i, (x, v) in enumerate(zip(k, w))]
    return spark.createDataFrame(rows, "feature string, knot int, x double, value double")
