"""Column-expression library: everything here is a JVM-side ``Column`` builder."""

from kindling.functions.columns import (
    activation,
    bce_on_logits,
    bce_on_probs,
    clean_name,
    hash_order,
    sigmoid,
    softplus,
)
from kindling.functions.arrays import (
    array_dot,
    array_layer_norm,
    array_sum,
    conv1d_same,
    entropy_score,
    feature_slices,
)

__all__ = [
    "activation", "bce_on_logits", "bce_on_probs", "clean_name", "hash_order", "sigmoid", "softplus",
    "array_dot", "array_layer_norm", "array_sum", "conv1d_same", "entropy_score", "feature_slices",
]
