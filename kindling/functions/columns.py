"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The natural-log floor the binary cross-entropy on probabilities
# applies to each log term, and the SELU constants.
LOG_FLOOR = -100.0
SELU_ALPHA = 1.6732632423543772
SELU_SCALE = 1.0507009873554805


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    """Logistic function ``1 / (1 + exp(-x))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softplus(x) -> Column:
    """Stable ``ln(1 + exp(x))`` = ``max(x, 0) + ln(1 + exp(-|x|))``."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log(F.lit(1.0) + F.exp(-F.abs(x)))


def bce_on_probs(p, y) -> Column:
    """Binary cross-entropy of a probability, each log term floored at -100; null for a null or NaN probability."""
    p, y = _c(p), _c(y).cast("double")
    q = F.lit(1.0) - p
    log_p = F.when(p > 0, F.greatest(F.log(p), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))
    log_q = F.when(q > 0, F.greatest(F.log(q), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))
    return F.when(p.isNotNull() & ~F.isnan(p), -(y * log_p + (F.lit(1.0) - y) * log_q))


def bce_on_logits(x, y, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy on a logit with a weight on the positive term.

    ``-(w·y·ln σ(x) + (1-y)·ln(1-σ(x)))`` = ``w·y·softplus(-x) + (1-y)·softplus(x)``.
    """
    x, y = _c(x), _c(y).cast("double")
    return F.lit(float(pos_weight)) * y * softplus(-x) + (F.lit(1.0) - y) * softplus(x)


def activation(x, name: str) -> Column:
    """Element activations expressible in SQL: identity, relu, sigmoid, tanh, selu, gelu_tanh."""
    x = _c(x)
    if name in ("identity", "linear", None):
        return x
    if name == "relu":
        return F.when(x > 0, x).when(x <= 0, F.lit(0.0))  # null stays null
    if name == "sigmoid":
        return sigmoid(x)
    if name == "tanh":
        return F.tanh(x)
    if name == "selu":
        return F.lit(SELU_SCALE) * F.when(x > 0, x).otherwise(F.lit(SELU_ALPHA) * (F.exp(x) - F.lit(1.0)))
    if name == "gelu_tanh":
        inner = F.lit(0.7978845608028654) * (x + F.lit(0.044715) * x * x * x)
        return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(inner))
    raise ValueError(f"unknown activation {name!r} (exact GELU needs erf, which Spark SQL lacks)")


def hash_order(key, salt: str) -> Column:
    """Repeatable pseudo-random order key: lowercase hex md5 of ``salt || key``."""
    return F.md5(F.concat(F.lit(salt), _c(key).cast("string")))


def clean_name(name: str) -> str:
    """Standardised column name: lower case, runs of other characters to one '_', trimmed."""
    out = re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")
    if not out:
        raise ValueError(f"column name {name!r} has no letters or digits")
    return out


# --- SQL text builders: wide tables get one selectExpr instead of thousands of Column calls ---

def sql_ident(name: str) -> str:
    """Backtick-quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(s: str) -> str:
    """Single-quoted string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(x: float) -> str:
    """Exact double literal (the shortest repr round-trips through the string cast)."""
    x = float(x)
    if x != x:
        text = "NaN"
    elif x in (float("inf"), float("-inf")):
        text = "Infinity" if x > 0 else "-Infinity"
    else:
        text = repr(x)
    return f"CAST('{text}' AS DOUBLE)"


def sql_clean_double(name: str) -> str:
    """The column as double with NaN turned into null."""
    v = f"CAST({sql_ident(name)} AS DOUBLE)"
    return f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"


def stack_expr(features, value_sql=None, name_col: str = "feature", value_col: str = "value") -> str:
    """``stack(n, 'f1', v1, …) AS (feature, value)``: long form as one generator expression."""
    value_sql = value_sql or (lambda c: f"CAST({sql_ident(c)} AS DOUBLE)")
    pairs = ", ".join(f"{sql_str(c)}, {value_sql(c)}" for c in features)
    return f"stack({len(features)}, {pairs}) AS ({sql_ident(name_col)}, {sql_ident(value_col)})"
