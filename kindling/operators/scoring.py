"""Table-scale scoring: the per-row computations of the networks as Spark jobs.

Every form is narrow (no shuffle). N1, N4 and N6 are projections over a few values per
row; dense and branch layers, convolutions, the frozen block and the network scorer
run as one ``mapInArrow`` pass that multiplies an (n, width) numpy matrix per Arrow
batch, whatever the size of the model. Weights are model parameters: they are
broadcast, and a model of more than ``MODEL_BYTES`` of weights is refused, since every
executor holds a copy. The long forms (``*_long``) express the same maths as joins
and aggregates on a ``(key, i, x)`` table; the tests use them as a cross-check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions import arrays as A
from kindling.functions.columns import activation, sql_ident

BN_EPS = 1e-5
MODEL_BYTES = 1 << 30  # of weights that are broadcast at most


def _weight_bytes(model) -> int:
    """Bytes of the numpy arrays inside tuples, lists and model objects."""
    if isinstance(model, np.ndarray):
        return model.nbytes
    if isinstance(model, (list, tuple)):
        return sum(map(_weight_bytes, model))
    return sum(map(_weight_bytes, vars(model).values())) if hasattr(model, "__dict__") else 0


def _share(df: DataFrame, model):
    """Broadcast a model's weights once their size is checked; a saved model goes as its address."""
    if getattr(model, "open_in_task", False):
        return model
    size = _weight_bytes(model)
    if size > MODEL_BYTES:
        raise ValueError(f"the model has {size} bytes of weights; at most MODEL_BYTES = {MODEL_BYTES} are broadcast")
    return df.sparkSession.sparkContext.broadcast(model)


# --- N1 --------------------------------------------------------------------------------------------

def entropy_scores(df: DataFrame, features: str, n_landcover: int = 4, k: float = 1.0,
                   alpha: Sequence[float] | None = None, out: str = "entropy_score") -> DataFrame:
    """Entropy score per row (N1), see :func:`kindling.functions.arrays.entropy_score`."""
    return df.withColumn(out, A.entropy_score(features, n_landcover, k, alpha))


# --- N2 --------------------------------------------------------------------------------------------

def _valid_rows(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A list column of an Arrow batch as (values, start, length, valid); a row is valid if neither it nor an
    element of it is null."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    present = col.is_valid().to_numpy(zero_copy_only=False)
    some = col.filter(pa.array(present))
    lens = np.zeros(len(col), np.int64)
    lens[present] = some.value_lengths().to_numpy(zero_copy_only=False)
    flat = some.flatten()
    start = np.concatenate([[0], np.cumsum(lens)])[:-1].astype(np.int64)
    missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    valid = present & (missing[start + lens] == missing[start])
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return values, start, lens, valid


def _list_array(y: np.ndarray, valid: np.ndarray):
    """(n, k) → list<double> with one row per entry of ``valid``, null where it is False; no per-row Python objects."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(valid * y.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(y, np.float64).ravel()),
                                    mask=pa.array(~valid))


def by_position(df: DataFrame) -> DataFrame:
    """Columns renamed by place: ``mapInArrow`` takes its input by name and fails on names with dots."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def _map_column(df: DataFrame, features: str, fn, out: str, out_type: T.DataType) -> DataFrame:
    """Add ``out`` = ``fn`` of the Arrow column ``features``, batch by batch; other columns pass through."""
    import pyarrow as pa

    at = df.columns.index(features)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name != out]
    schema = T.StructType([df.schema.fields[i] for i in keep] + [T.StructField(out, out_type)])

    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in keep] + [fn(rb.column(at))], names=names)

    names = schema.names
    return by_position(df).mapInArrow(run, schema)


def map_vectors(df: DataFrame, features: str, fn, out: str, width: int) -> DataFrame:
    """Apply ``fn`` ((n, width) matrix → (n, k) array) to a vector column in Arrow batches with ``mapInArrow``; every
    other column passes through untouched. A vector that is null, has a null element or is not ``width`` long gives
    null."""
    def one(col):
        values, start, lens, valid = _valid_rows(col)
        valid &= lens == width
        x = values[start[valid][:, None] + np.arange(width)]
        return _list_array(fn(x), valid)

    return _map_column(df, features, one, out, T.ArrayType(T.DoubleType()))


def dense_layer(df: DataFrame, features: str, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None,
                act: str = "identity", out: str = "hidden") -> DataFrame:
    """``act(x · W + b)`` on an array column (N2); ``weights`` are I × J rows.

    One Arrow-batched matmul with broadcast weights, whatever their number; other columns pass through. Vectors that
    are null, hold a null or have another length than I give null."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)
    _np_act(np.zeros(1), act)  # an unknown activation fails here, not in a task
    bc = _share(df, (w, b, act))

    def fn(x):
        wm, bv, a = bc.value
        return _np_act(x @ wm + bv, a)

    return map_vectors(df, features, fn, out, w.shape[0])


def _np_act(x: np.ndarray, act: str) -> np.ndarray:
    if act in ("identity", "linear", None):
        return x
    if act == "relu":
        return np.maximum(x, 0.0)
    if act == "sigmoid":
        return 1.0 / (1.0 + np.exp(-x))
    if act == "tanh":
        return np.tanh(x)
    if act == "selu":
        from kindling.functions.columns import SELU_ALPHA, SELU_SCALE

        return SELU_SCALE * np.where(x > 0, x, SELU_ALPHA * (np.exp(x) - 1.0))
    if act == "gelu_tanh":
        return 0.5 * x * (1.0 + np.tanh(0.7978845608028654 * (x + 0.044715 * x ** 3)))
    if act == "gelu":
        return _gelu(x)
    raise ValueError(f"unknown activation {act!r}")


def dense_layer_long(long: DataFrame, weights: DataFrame, bias: DataFrame, key: str = "key",
                     act: str = "identity") -> DataFrame:
    """Long form of N2: ``(key, i, x)`` ⋈ ``(i, j, w)`` → ``groupBy(key, j)`` Σ x·w, + ``(j, b)``.

    Rows grow by J, so this form is the check, not the default. The weight table's
    size is not known here, so the join strategy is left to AQE's runtime size check."""
    prod = long.join(weights, "i").groupBy(key, "j").agg(F.sum(F.col("x") * F.col("w")).alias("z"))
    return prod.join(bias, "j").select(key, "j", activation(F.col("z") + F.col("b"), act).alias("h"))


# --- N3 / N4 ---------------------------------------------------------------------------------------

def _usable(c: str) -> F.Column:
    """The column as double with NaN as null."""
    x = F.col(sql_ident(c)).cast("double")
    return F.when(~F.isnan(x), x)


def fit_batch_norm(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Table mean and population variance per column: ``(feature, mean, var)`` (N3 statistics); null and NaN values
    are skipped, a column without values has null for both."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_usable(c)).alias(f"m{i}"), F.var_pop(_usable(c)).alias(f"v{i}")]
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
                                         F.col(f"v{i}").alias("var")) for i, c in enumerate(cols)]))
    return df.agg(*aggs).select(stack.alias("s")).select("s.*")


def batch_norm(df: DataFrame, cols: Sequence[str], params: DataFrame | dict | None = None, eps: float = BN_EPS,
               suffix: str = "", scale: dict | None = None, shift: dict | None = None) -> DataFrame:
    """``scale · (x - mean) / sqrt(var + eps) + shift`` per column (N3), statistics of this table unless ``params`` (a
    fitted ``(feature, mean, var)`` table or dict, which may hold further features) is given; scale 1 and shift 0
    unless the dicts name a column. A null or NaN value, and every value of a column without statistics, gives null."""
    p = params if params is not None else fit_batch_norm(df, cols)
    if not isinstance(p, dict):
        rows = p.where(F.col("feature").isin(list(cols))).collect()  # the rows of the asked columns
        p = {r["feature"]: (r["mean"], r["var"]) for r in rows}
    missing = [c for c in cols if c not in p]
    if missing:
        raise ValueError(f"no batch-norm parameters for {missing}")
    new = {}
    for c in cols:
        mean, var = p[c]
        if mean is None or var is None:
            new[c + suffix] = F.lit(None).cast("double")
            continue
        x = (_usable(c) - F.lit(float(mean))) / F.lit(float(np.sqrt(var + eps)))
        new[c + suffix] = x * F.lit(float((scale or {}).get(c, 1.0))) + F.lit(float((shift or {}).get(c, 0.0)))
    return df.withColumns(new)


def layer_norm(df: DataFrame, features: str, eps: float = BN_EPS, out: str | None = None,
               scale: Sequence[float] | None = None, shift: Sequence[float] | None = None) -> DataFrame:
    """Normalise each row's vector by its own mean and population variance (N4), then scale and shift by position."""
    y = A.array_layer_norm(features, eps)
    if scale is not None:
        y = F.zip_with(y, A.lit_array(scale), lambda a, b: a * b)
    if shift is not None:
        y = F.zip_with(y, A.lit_array(shift), lambda a, b: a + b)
    return df.withColumn(out or features, y)


# --- N5 --------------------------------------------------------------------------------------------

def conv_features(df: DataFrame, features: str, kernels: Sequence[Sequence[float]], act: str = "identity",
                  out: str = "conv") -> DataFrame:
    """Width-3, zero-padded convolution along the feature order with one output per
    kernel ``(l, m, r, b)`` (N5): ``array<array<double>>`` of filters × positions.

    Shifted products over each Arrow batch, for vectors of any length; a vector that is null or holds a null gives
    null."""
    k = np.asarray(kernels, dtype=np.float64)
    _np_act(np.zeros(1), act)
    bc = _share(df, (k, act))

    def fn(col):
        import pyarrow as pa

        kern, a = bc.value
        values, start, lens, valid = _valid_rows(col)
        prev, nxt = np.zeros_like(values), np.zeros_like(values)
        prev[1:], nxt[:-1] = values[:-1], values[1:]
        some = lens > 0
        prev[start[some]] = 0.0
        nxt[(start + lens - 1)[some]] = 0.0
        y = np.concatenate([_np_act(l * prev + m * values + r * nxt + b, a) for l, m, r, b in kern])
        n = np.repeat(lens[valid], len(kern))  # one run of values per (row, kernel)
        begin = (start[valid][:, None] + np.arange(len(kern)) * len(values)).ravel()
        ends = np.cumsum(n)
        y = y[np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))]
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(y))
        outer = np.concatenate([[0], np.cumsum(valid * len(kern))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), inner, mask=pa.array(~valid))

    return _map_column(df, features, fn, out, T.ArrayType(T.ArrayType(T.DoubleType())))


# --- N6 --------------------------------------------------------------------------------------------

def _or_zero(x) -> F.Column:
    """The value as double; null and NaN count as 0, as in the fits."""
    x = x.cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


@dataclass(frozen=True)
class Bins:
    """Equal-width bins ``[lo + b·width, lo + (b+1)·width)``; values outside go to the end bins."""

    lo: float
    width: float
    n: int

    def index(self, x) -> F.Column:
        b = F.floor((_or_zero(x) - F.lit(float(self.lo))) / F.lit(float(self.width)))
        return F.least(F.greatest(b, F.lit(0)), F.lit(self.n - 1)).cast("int")


@dataclass(frozen=True)
class Edges:
    """Bins between ascending inner edges ``e``: bin k holds ``e[k-1] <= x < e[k]`` (what a quantile fit gives)."""

    inner: tuple

    def index(self, x) -> F.Column:
        v = _or_zero(x)
        return sum((F.when(v >= e, 1).otherwise(0) for e in self.inner), F.lit(0)).cast("int")


def additive_scores(df: DataFrame, bins: dict[str, Bins | Edges], shapes: dict[str, Sequence[float]], bias: float = 0.0,
                    out: str = "additive_score") -> DataFrame:
    """Generalised additive score ``b + Σ_f g_f(x_f)`` with tabulated shape functions.

    Each feature's value picks its bin's weight from a literal array: a narrow
    projection. A null or NaN feature value counts as 0, whatever the kind of bins."""
    total = F.lit(float(bias))
    for f, b in bins.items():
        w = A.lit_array(shapes[f])
        total = total + F.coalesce(F.element_at(w, b.index(F.col(f)) + 1), F.lit(0.0))
    return df.withColumn(out, total)


def additive_scores_long(long: DataFrame, bins: dict[str, Bins], shape_table: DataFrame, key: str,
                         bias: float = 0.0) -> DataFrame:
    """Long form of N6: ``unpivot`` → bin → join the ``(feature, bin, w)`` table → ``groupBy(key)``."""
    bin_col = None
    for f, b in bins.items():
        e = F.when(F.col("feature") == f, b.index(F.col("value")))
        bin_col = e if bin_col is None else F.coalesce(bin_col, e)
    binned = long.withColumn("bin", bin_col)
    return (binned.join(shape_table, ["feature", "bin"], "left")  # join strategy left to AQE
            .groupBy(key).agg((F.lit(float(bias)) + F.sum(F.coalesce("w", F.lit(0.0)))).alias("additive_score")))


# --- N9 --------------------------------------------------------------------------------------------

def branch_concat(df: DataFrame, features: str, branch_weights: Sequence[Sequence[Sequence[float]]],
                  branch_bias: Sequence[Sequence[float]], residual_weights: Sequence[Sequence[float]],
                  act: str = "relu", out: str = "branches") -> DataFrame:
    """Multi-branch features (N9): contiguous slices, a dense layer per slice, concatenation, and a residual add of a
    linear map of the whole vector, in one numpy pass per Arrow batch. Vectors that are null, hold a null or have
    another length than the residual weights give null."""
    ws = [np.asarray(w, dtype=np.float64) for w in branch_weights]
    bs = [np.asarray(b, dtype=np.float64) for b in branch_bias]
    r = np.asarray(residual_weights, dtype=np.float64)
    _np_act(np.zeros(1), act)
    bc = _share(df, (ws, bs, r, act))

    def fn(x):
        wl, bl, rm, a = bc.value
        k = len(wl)
        base = x.shape[1] // k
        edges = [i * base for i in range(k)] + [x.shape[1]]
        parts = [_np_act(x[:, edges[i]:edges[i + 1]] @ wl[i] + bl[i], a) for i in range(k)]
        return np.concatenate(parts, axis=1) + x @ rm

    return map_vectors(df, features, fn, out, r.shape[0])


# --- N7 / N8: numpy batches -----------------------------------------------------------------------

_ERF_TERMS = 90


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function as array arithmetic: the series 2/sqrt(pi) · exp(-x²) · Σ 2ⁿ x²ⁿ⁺¹ / (1·3·…·(2n+1)), all of
    whose terms have one sign, up to |x| = 6; beyond that it is ±1 in double precision."""
    z = np.clip(np.abs(x), 0.0, 6.0)
    term = total = z.copy()
    for n in range(1, _ERF_TERMS):
        term = term * (2.0 * z * z / (2 * n + 1))
        total = total + term
        if n % 10 == 0 and not (term > 1e-17 * total).any():
            break
    return np.sign(x) * np.minimum(2.0 / np.sqrt(np.pi) * np.exp(-z * z) * total, 1.0)


def _gelu(x: np.ndarray) -> np.ndarray:
    """Exact GELU ``x·Φ(x)`` (Spark SQL has no erf)."""
    return 0.5 * x * (1.0 + _erf(x / np.sqrt(2.0)))


def _layer_norm_np(x: np.ndarray, eps: float = BN_EPS) -> np.ndarray:
    mu = x.mean(axis=1, keepdims=True)
    var = x.var(axis=1, keepdims=True)
    return (x - mu) / np.sqrt(var + eps)


def _xavier(rng: np.random.Generator, fan_in: int, fan_out: int) -> np.ndarray:
    a = np.sqrt(6.0 / (fan_in + fan_out))
    return rng.uniform(-a, a, size=(fan_in, fan_out))


@dataclass
class FrozenBlock:
    """Weights of a pre-norm transformer block applied to a length-1 sequence.

    With one token the attention softmax is over one key and equals 1, so attention
    is ``out(v(x))``; query and key weights cannot change the output and are not kept.
    """

    wv: np.ndarray
    bv: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    act: str = "gelu"

    @classmethod
    def random(cls, width: int, seed: int = 42, expansion: int = 4) -> FrozenBlock:
        rng = np.random.default_rng(seed)
        h = width * expansion
        z = np.zeros
        return cls(_xavier(rng, width, width), z(width), _xavier(rng, width, width), z(width),
                   _xavier(rng, width, h), z(h), _xavier(rng, h, width), z(width))

    @property
    def width(self) -> int:
        return self.wv.shape[0]

    def n_values(self) -> int:
        return sum(a.size for a in self.__dict__.values() if isinstance(a, np.ndarray))

    def forward(self, x: np.ndarray) -> np.ndarray:
        h = x
        a = _layer_norm_np(h)
        h = h + ((a @ self.wv + self.bv) @ self.wo + self.bo)
        f = _layer_norm_np(h)
        return h + (_np_act(f @ self.w1 + self.b1, self.act) @ self.w2 + self.b2)


def with_frozen_features(df: DataFrame, features: str, block: FrozenBlock, out: str = "frozen") -> DataFrame:
    """``df`` with the features of a frozen block (N7): one Arrow-batched pass, weights broadcast once, or opened by the tasks from a ``SavedModel``; no join.
    float32 in, float32 out as the block's features; the maths runs in float64."""
    bc = _share(df, block)

    def fn(x):
        return bc.value.forward(x.astype(np.float32).astype(np.float64)).astype(np.float32)

    mapped = map_vectors(df, features, fn, out, block.width)
    return mapped.withColumn(out, F.col(out).cast("array<float>"))


def frozen_block_features(df: DataFrame, features: str, block: FrozenBlock, key: str,
                          out: str = "frozen") -> DataFrame:
    """``(key, out)`` of :func:`with_frozen_features`."""
    return with_frozen_features(df.select(key, features), features, block, out).select(key, out)


@dataclass
class DenseNet:
    """A feed-forward scorer given as weight matrices: ``[(W, b, activation), …]`` ending in one logit."""

    layers: list

    @classmethod
    def random(cls, sizes: Sequence[int], seed: int = 42, act: str = "gelu") -> DenseNet:
        rng = np.random.default_rng(seed)
        layers = []
        for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
            layers.append((_xavier(rng, a, b), np.zeros(b), act if i < len(sizes) - 2 else "identity"))
        return cls(layers)

    @property
    def width(self) -> int:
        return self.layers[0][0].shape[0]

    def n_values(self) -> int:
        return sum(w.size + b.size for w, b, _ in self.layers)

    def logits(self, x: np.ndarray) -> np.ndarray:
        for w, b, act in self.layers:
            x = _np_act(x @ w + b, act)
        return x[:, 0]


def batch_score(df: DataFrame, features: str, model, key: str, model_name: str = "model",
                label: str | None = None) -> DataFrame:
    """Score every row (N8) → ``(key, model, [label,] score)`` with ``score = sigmoid(logit)``.

    ``model`` is a fitted Spark ML model (its ``probability`` column is used) or a
    :class:`DenseNet`, or a ``SavedModel`` of one, run in one ``mapInArrow`` pass; vectors that are null, hold a null or
    have another length than the first layer score null. Narrow: no shuffle either way.
    """
    keep = [key] + ([label] if label else [])
    if isinstance(model, DenseNet) or getattr(model, "kind", None) == "DenseNet":
        bc = _share(df, model)

        def fn(x):
            return 1.0 / (1.0 + np.exp(-bc.value.logits(x)))[:, None]

        scored = map_vectors(df.select(*keep, features), features, fn, "_score", model.width)
        scored = scored.select(*keep, F.get("_score", F.lit(0)).alias("score"))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))
    return scored.select(key, F.lit(model_name).alias("model"), *([label] if label else []), "score")
