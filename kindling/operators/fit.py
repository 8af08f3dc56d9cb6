"""Fitting class-weighted binary classifiers with Spark ML.

Fits are distributed Spark ML jobs (L-BFGS with tree-aggregated gradients); the
driver holds only coefficients. ``prepare`` checkpoints the balanced sample once into
the shared checkpoint folder; the prepared table is a projection of it, read by
every fit and evaluation without recomputing the sample.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, QuantileDiscretizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.operators import evaluate as E
from kindling.functions.columns import sql_clean_double, sql_ident
from kindling.operators.network import fit_weights
from kindling.operators.scoring import FrozenBlock, with_frozen_features

POS_WEIGHT = 2.0  # fixed value: weight of the positive class in the benchmark's loss


def class_weight(label: str, pos_weight: float) -> F.Column:
    return F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0))


def _filled(features: Sequence[str]) -> tuple[SQLTransformer, list[str]]:
    """The one null rule of all fits: a null or NaN feature counts as 0, the mean of a scaled feature, so every model
    fits and scores every row. A pipeline stage (saved with the model) and the columns it adds."""
    cols = [f"_f{i}" for i in range(len(features))]
    exprs = ", ".join(f"coalesce({sql_clean_double(c)}, 0D) AS {sql_ident(o)}" for c, o in zip(features, cols))
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"), cols


#: multiply-adds of a fit that make up one task's share, and the least rows of a task beyond one per core
TASK_COST, TASK_ROWS = 5e9, 100_000


def spread_rows(train: DataFrame, weights: int, iterations: int) -> DataFrame:
    """``train`` dealt over tasks by the cost of an iterative fit (rows × weights × iterations), not by file size.

    A small file is one partition, and an iterative fit on it one task for all its iterations. The rows are counted
    and dealt round robin: one task per ``TASK_COST``, as many as there are cores at most or, on large tables, so many
    full rounds of the cores that a task has ``TASK_ROWS`` rows at most. A fit worth less than two shares keeps its partitions. Gradients are summed over all rows, so only the order of
    additions depends on the dealing."""
    rows = train.count()
    cores = train.sparkSession.sparkContext.defaultParallelism
    most = cores * max(1, -(-rows // (cores * TASK_ROWS)))
    n = min(most, int(rows * weights * iterations // TASK_COST) + 1, max(rows, 1))
    return train.repartition(n) if n > 1 else train


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", pos_weight: float = POS_WEIGHT,
                 reg: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """Class-weighted logistic regression."""
    data = spread_rows(train.withColumn("_w", class_weight(label, pos_weight)), len(features) + 1, max_iter)
    fill, cols = _filled(features)
    pipe = Pipeline(stages=[
        fill, VectorAssembler(inputCols=cols, outputCol="_fv"),
        LogisticRegression(featuresCol="_fv", labelCol=label, weightCol="_w", regParam=reg, maxIter=max_iter)])
    return pipe.fit(data)


def repeat_positives(df: DataFrame, label: str, times: int) -> DataFrame:
    """Each positive row ``times`` times: an integer class weight for learners without
    ``weightCol`` (same fit as the weights for a weighted mean loss)."""
    n = F.when(F.col(label) == 1, F.lit(int(times))).otherwise(F.lit(1))
    return df.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), n))).drop("_rep")


def fit_mlp(train: DataFrame, features: Sequence[str], label: str = "label", hidden: Sequence[int] = (256, 128, 64),
            pos_weight: int = 2, max_iter: int = 100, seed: int = 42) -> PipelineModel:
    """Feed-forward network (T2): Spark's MLP (sigmoid hidden units, softmax output).

    The weights are fitted by :func:`~kindling.operators.network.fit_weights`, whose tasks use numpy's matrix products
    and weighted rows; Spark's class gives the first weights of ``seed`` and the model."""
    if float(pos_weight) != int(pos_weight):
        raise ValueError("the MLP takes an integer positive weight")
    layers = [len(features), *hidden, 2]
    weights = sum((a + 1) * b for a, b in zip(layers[:-1], layers[1:]))
    fill, cols = _filled(features)
    rows = fill.transform(train.withColumn("_w", class_weight(label, pos_weight))).select(
        *cols, F.col(label).cast("double").alias("_y"), "_w")
    fill_vector = VectorAssembler(inputCols=cols, outputCol="_fv")
    # no iteration over one row of zeros: a model of the weights it starts with
    still = MultilayerPerceptronClassifier(featuresCol="_fv", labelCol=label, layers=layers, maxIter=0, seed=seed)
    zeros = fill_vector.transform(train.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in cols], F.lit(0.0).alias(label)))
    start = still.fit(zeros).weights.toArray()
    fitted = fit_weights(spread_rows(rows, weights, max_iter), layers, start, max_iter)
    return PipelineModel(stages=[fill, fill_vector, still.setInitialWeights(Vectors.dense(fitted)).fit(zeros)])


def fit_additive(train: DataFrame, features: Sequence[str], label: str = "label", n_bins: int = 10,
                 pos_weight: float = POS_WEIGHT, reg: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """Binned additive logistic model (T3): one shape value per (feature, quantile bin)."""
    fill, feats = _filled(features)
    bins = [f"{c}_bin" for c in feats]
    ohe = [f"{c}_ohe" for c in feats]
    data = spread_rows(train.withColumn("_w", class_weight(label, pos_weight)), len(feats) * n_bins, max_iter)
    pipe = Pipeline(stages=[
        fill, QuantileDiscretizer(inputCols=feats, outputCols=bins, numBuckets=n_bins, handleInvalid="keep"),
        OneHotEncoder(inputCols=bins, outputCols=ohe, handleInvalid="keep"),
        VectorAssembler(inputCols=ohe, outputCol="_fv"),
        LogisticRegression(featuresCol="_fv", labelCol=label, weightCol="_w", regParam=reg, maxIter=max_iter)])
    return pipe.fit(data)


@dataclass
class FrozenHeadModel:
    """Frozen-block features followed by a fitted logistic head (T4)."""

    block: FrozenBlock
    head: PipelineModel
    features: list
    key: str

    def transform(self, df: DataFrame) -> DataFrame:
        return self.head.transform(_frozen_vector(df, self.features, self.block))


def _frozen_vector(df: DataFrame, features: Sequence[str], block: FrozenBlock) -> DataFrame:
    """``df`` with the frozen features as the vector ``_fv``: one narrow pass, no join."""
    fill, cols = _filled(features)
    arr = fill.transform(df).withColumn("_x", F.array(*cols).cast("array<float>"))
    return with_frozen_features(arr, "_x", block, "_frozen").withColumn("_fv", array_to_vector("_frozen")).drop(
        *cols, "_x", "_frozen")


def fit_frozen_head(train: DataFrame, features: Sequence[str], key: str, label: str = "label",
                    block: FrozenBlock | None = None, pos_weight: float = POS_WEIGHT,
                    max_iter: int = 100) -> FrozenHeadModel:
    """Logistic head on frozen-block features (T4)."""
    feats = list(features)
    block = block or FrozenBlock.random(len(feats), seed=42)
    # the frozen block itself is the cost: one pass over it
    dealt = spread_rows(train, sum(a.size for n, a in vars(block).items() if n != "act"), 1)
    data = _frozen_vector(dealt, feats, block).withColumn("_w", class_weight(label, pos_weight))
    lr = LogisticRegression(featuresCol="_fv", labelCol=label, weightCol="_w", maxIter=max_iter)
    return FrozenHeadModel(block, PipelineModel(stages=[lr.fit(data)]), feats, key)


def additive_tables(model: PipelineModel, features: Sequence[str]) -> tuple[dict, dict, float]:
    """The shape tables of a fitted additive model (T3) as ``(bins, shapes, bias)`` for ``additive_scores`` (N6): per
    feature the inner quantile edges and one weight per bin."""
    from kindling.operators.scoring import Edges

    lr = model.stages[-1]
    discretizer = next(s for s in model.stages if s.hasParam("splitsArray"))
    encoder = next(s for s in model.stages if s.hasParam("dropLast") and hasattr(s, "categorySizes"))
    weights, at, bins, shapes = lr.coefficients.toArray(), 0, {}, {}
    for f, splits, size in zip(features, discretizer.getSplitsArray(), encoder.categorySizes):
        n = len(splits) - 1
        bins[f] = Edges(tuple(float(x) for x in splits[1:-1]))
        shapes[f] = [float(weights[at + k]) if k < size else 0.0 for k in range(n)]
        at += size  # handleInvalid="keep" adds a category and dropLast takes one away
    return bins, shapes, float(lr.intercept)


def parameter_count(model) -> int:
    """Number of fitted parameters of the models above."""
    if isinstance(model, FrozenHeadModel):
        return parameter_count(model.head)
    if hasattr(model, "n_values"):
        return int(model.n_values())
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "weights") and hasattr(last, "getLayers"):
        return int(last.weights.size)
    if hasattr(last, "coefficients"):
        return int(last.coefficients.size) + 1
    raise TypeError(f"cannot count parameters of {type(model).__name__}")


def score(model, df: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Scored table ``(key, model, label, score)`` with the positive-class probability."""
    out = model.transform(df)
    return out.select(F.col(key).alias("key"), F.lit(name).alias("model"), F.col(label).cast("int").alias("label"),
                      vector_to_array("probability")[1].alias("score"))


def fit_and_evaluate(prepared: DataFrame, specs: dict, features: Sequence[str], key: str, label: str = "label",
                     part_col: str = "part") -> tuple[DataFrame, DataFrame]:
    """Fit every model on the train part and evaluate on the valid part (T5).

    ``specs`` maps a model name to a fitting callable ``(train, features, key, label) -> model``.
    All models' scores of the valid part make one scored table, evaluated in one job.
    Returns (evaluations, comparison table); fit time is measured around each fit.
    """
    train = prepared.filter(F.col(part_col) == "train")
    valid = prepared.filter(F.col(part_col) == "valid")
    spark = prepared.sparkSession
    scores, meta = [], []
    for name, fit in specs.items():
        t0 = time.time()
        model = fit(train, features, key, label)
        fit_time = time.time() - t0
        scores.append(score(model, valid, key, label, name))
        meta.append((name, fit_time, parameter_count(model)))
    scored = scores[0]
    for s in scores[1:]:
        scored = scored.unionByName(s)
    all_evals = E.evaluation(scored, find_best=True)
    meta_df = spark.createDataFrame(meta, "model string, training_time double, parameters bigint")
    return all_evals, E.model_comparison(all_evals, meta_df)


DEFAULT_SPECS = {
    "logistic": lambda tr, f, k, y: fit_logistic(tr, f, y),
    "mlp": lambda tr, f, k, y: fit_mlp(tr, f, y, hidden=(256, 128, 64), max_iter=50),
    "additive": lambda tr, f, k, y: fit_additive(tr, f, y, n_bins=10),
    "frozen_head": lambda tr, f, k, y: fit_frozen_head(tr, f, k, y),
}
