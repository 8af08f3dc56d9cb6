"""Array-column math: one row's feature vector is an ``array<float|double>`` column.

These are higher-order functions (``transform``, ``aggregate``, ``zip_with``): per-row vector work needs no
shuffle and no Python, but Spark evaluates their lambdas interpreted, element by element. They suit a few values per
row; products with weight matrices are Arrow-batched numpy in ``operators.scoring``.
Weights are model parameters and enter as literal arrays; their size is the model
size, never the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindling.functions.columns import activation

# Fixed value: the constant added inside the logarithm of the entropy term.
ENTROPY_LOG_EPS = 1e-10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Expressions written inside a ``transform``/``aggregate`` lambda run once per
    element; binding row-level statistics here keeps them once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def array_sum(arr) -> Column:
    """Left-to-right sum of the elements as double (0.0 for an empty array)."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def array_dot(arr, weights) -> Column:
    """Σ arr[i]·w[i]; ``weights`` is a literal sequence or an array column of the same length."""
    w = lit_array(weights) if not isinstance(weights, Column) else weights
    return array_sum(F.zip_with(_c(arr), w, lambda x, y: x.cast("double") * y))


def dense(arr, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None,
          act: str = "identity") -> Column:
    """Dense layer on an array column: ``act(x · W + b)`` with ``W`` given as I × J rows.

    Returns an ``array<double>`` of J outputs.
    """
    n_out = len(weights[0])
    bias = bias if bias is not None else [0.0] * n_out
    outs = []
    for j in range(n_out):
        col_j = [row[j] for row in weights]
        outs.append(activation(array_dot(arr, col_j) + F.lit(float(bias[j])), act))
    return F.array(*outs)


def entropy_score(arr, n_landcover: int = 4, k: float = 1.0, alpha: Sequence[float] | None = None) -> Column:
    """Entropy score of one feature vector.

    The first ``L = min(n_landcover, width)`` values are turned into shares by a
    softmax; the score is ``k · (-Σ p·ln(p + 1e-10)) + Σ αⱼ·fⱼ`` over the remaining
    values fⱼ. ``alpha`` is cut to the number of remaining values (all ones when
    not given); remaining values beyond a shorter ``alpha`` get weight 0.
    """
    a = _c(arr)
    lc = F.slice(a, 1, n_landcover)

    def shares_term(e):  # e = exp(x - max) of the land-cover values, bound once
        return let(array_sum(e), lambda z: -F.lit(float(k)) * F.aggregate(
            e, F.lit(0.0), lambda acc, v: acc + (v / z) * F.log(v / z + F.lit(ENTROPY_LOG_EPS))))

    ent = let(lc, lambda xs: let(F.array_max(xs).cast("double"), lambda m: shares_term(
        F.transform(xs, lambda x: F.exp(x.cast("double") - m)))))
    rest = F.slice(a, n_landcover + 1, F.greatest(F.size(a) - F.lit(n_landcover), F.lit(0)))
    if alpha is None:
        env = array_sum(rest)
    else:
        w = lit_array(alpha)
        env = let(rest, lambda r: array_sum(F.zip_with(
            r, F.slice(w, 1, F.greatest(F.size(r), F.lit(1))),
            lambda x, y: x.cast("double") * F.coalesce(y, F.lit(0.0)))))  # a null element makes the score null
    return ent + env


def conv1d_same(arr, kernel: Sequence[float], bias: float = 0.0) -> Column:
    """One filter of a width-3 convolution along the vector with zero padding 1.

    ``y[t] = l·x[t-1] + m·x[t] + r·x[t+1] + b`` where missing neighbours are 0.
    """
    l, mid, r = (float(v) for v in kernel)

    def body(a):
        return F.transform(
            a,
            lambda x, i: F.lit(l) * F.coalesce(F.get(a, i - 1).cast("double"), F.lit(0.0))
            + F.lit(mid) * x.cast("double")
            + F.lit(r) * F.coalesce(F.get(a, i + 1).cast("double"), F.lit(0.0))
            + F.lit(float(bias)))

    return body(arr) if isinstance(arr, str) else let(arr, body)


def conv1d_filters(arr, kernels: Sequence[Sequence[float]], act: str = "identity") -> Column:
    """All filters: ``kernels`` rows are ``(l, m, r, b)``; returns ``array<array<double>>``."""
    outs = []
    for l, mid, r, b in kernels:
        outs.append(F.transform(conv1d_same(arr, (l, mid, r), b), lambda v: activation(v, act)))
    return F.array(*outs)


def array_layer_norm(arr, eps: float = 1e-5) -> Column:
    """Normalise within one vector: ``(x - mean) / sqrt(var_pop + eps)``."""

    def body(a):
        n = F.size(a).cast("double")
        return let(array_sum(a) / n, lambda mean: let(
            F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean)) / n,
            lambda var: F.transform(a, lambda x: (x.cast("double") - mean) / F.sqrt(var + F.lit(float(eps))))))

    return let(_c(arr), body)


def feature_slices(arr, n_slices: int = 4) -> list[Column]:
    """Contiguous slices: ``n_slices - 1`` slices of ``width // n_slices``, the rest to the last."""
    a = _c(arr)
    width = F.size(a)
    base = F.floor(width / F.lit(n_slices)).cast("int")
    out = []
    for i in range(n_slices):
        start = base * F.lit(i) + F.lit(1)
        length = base if i < n_slices - 1 else width - base * F.lit(n_slices - 1)
        out.append(F.slice(a, start, length))
    return out


def residual_add(a, b) -> Column:
    """Element-wise ``a + b`` of two equal-length vectors."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))
