"""Importance of a fitted model's features: how much AUC is lost when one feature's values are dealt anew.

The permutation is distributed and repeatable: every row has an exact place in the md5 order of its key under one
salt, and takes a feature's value from the row that has this place under another salt. That is one join on the place,
whatever the number of features. Each row is then scored once as it is and once per feature with that feature's value
replaced, all in one pass; the variants are evaluated as so many models in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.operators import evaluate as E
from kindling.operators.scan import row_index

WHOLE = "__whole"  # the variant with all features as they are


def permuted_values(df: DataFrame, features: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``__d``: a struct (d0, d1, ...) of the features of the row whose values this row takes.

    Every row gives its values to exactly one row. ``key`` must be unique and not null (rows without a key are left
    out); a repeated key makes the choice among its rows arbitrary."""
    known = df.where(F.col(key).isNotNull())
    takers = row_index(known, key, f"take:{seed}:", out="__place")
    givers = row_index(known.select(key, *features), key, f"give:{seed}:", out="__place")
    givers = givers.select("__place", F.struct(*[F.col(c).alias(f"d{i}") for i, c in enumerate(features)]).alias("__d"))
    return takers.join(givers, "__place").drop("__place")


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], features: Sequence[str], key: str,
                           label: str = "label", seed: int = 42, top: int = 30) -> DataFrame:
    """``(feature, auc, auc_permuted, importance)``: the ``top`` features by drop in AUC (E6), largest first, then by name.

    ``score`` maps a table with the key, label and feature columns to one with a ``score`` column (other columns kept),
    row by row; a fitted model's ``transform`` and a select will do. The table is scored ``1 + len(features)`` times in
    one pass. A feature the model does not use drops by exactly 0; one whose noise helps drops below 0. A table of one
    class has no AUC: all columns but the name are null.
    """
    features = list(features)
    variants = F.explode(F.array(F.lit(-1), *[F.lit(i) for i in range(len(features))])).alias("__variant")
    many = permuted_values(df.select(key, label, *features), features, key, seed).select("*", variants)
    many = many.withColumns({c: F.when(F.col("__variant") == i, F.col(f"__d.d{i}")).otherwise(F.col(c)) for i, c in enumerate(features)})
    scored = score(many.drop("__d"))
    scored = scored.select(F.col("__variant").cast("string").alias("model"), F.col(label).alias("label"), F.col("score"))
    auc = E.auc(scored)
    whole = auc.where("model = '-1'").select(F.col("auc").alias("__whole"))
    names = df.sparkSession.createDataFrame([(str(i), f) for i, f in enumerate(features)], "model string, feature string")
    out = names.join(auc, "model", "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    out = out.select("feature", F.col("__whole").alias("auc"), F.col("auc").alias("auc_permuted"),
                     (F.col("__whole") - F.col("auc")).alias("importance"))
    return E.top_n(out, "importance", top, tie="feature")
