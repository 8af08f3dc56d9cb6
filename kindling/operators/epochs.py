"""Epoch-wise fit with a history of its own, early stopping and the best model restored (T6 with T5).

An epoch continues the fit of the epoch before (``initialWeights``) for a few solver iterations, scores the train and
the valid part in one pass and evaluates both in one job from their per-score counts. Its metrics become one row of a
history table; the control of the loop is :func:`~kindling.operators.history.early_stop` on that table, so the table
alone says where the fit stopped and which epoch's model is used. The model of every epoch is saved under the run's
folder (shared storage), never only held by the driver: a run that is ended is continued where its table ends.

The vectors are written once; every epoch reads them there, dealt over the cores by the cost of the fit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions.columns import sql_clean_double
from kindling.operators import evaluate as E
from kindling.operators.fit import POS_WEIGHT, repeat_positives, spread_rows
from kindling.operators.history import DEFAULT_THRESHOLD, HISTORY_SERIES, early_stop
from kindling.session import cut_lineage

HISTORY = "run string, epoch int, " + ", ".join(f"{c} double" for c in HISTORY_SERIES) + ", searched boolean"


@dataclass
class EpochModel:
    """The model of the best epoch with the threshold that goes with it."""

    model: MultilayerPerceptronClassificationModel
    features: list
    epoch: int
    threshold: float

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(with_vector(df, self.features))


def with_vector(df: DataFrame, features: Sequence[str], out: str = "_fv") -> DataFrame:
    """``df`` with the features as one vector; null and NaN count as 0, as in all fits."""
    return df.withColumn(out, array_to_vector(F.expr(
        "array(" + ", ".join(f"coalesce({sql_clean_double(c)}, 0D)" for c in features) + ")")))


def history_table(spark: SparkSession, folder: str) -> DataFrame:
    """The history of the runs in ``folder``, ordered by run and epoch (what E17 and T6 read)."""
    return spark.read.schema(HISTORY).json(f"{folder}/history").orderBy("run", "epoch")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def evaluate_parts(model, rows: DataFrame, threshold: float | None, pos_weight: float) -> dict:
    """Metrics of both parts from one scoring pass: a row per part. The valid part uses ``threshold`` or, if that is
    None, the F1-optimal one; the accuracy of the train part is at 0.5."""
    scored = model.transform(rows).select(F.col("part").alias("model"), "label", vector_to_array("probability")[1].alias("score"))
    counts = E.score_counts(scored, materialize=True)
    both = E.evaluation_from_counts(counts, threshold, find_best=threshold is None, pos_weight=pos_weight)
    half = E.rates(E.confusion_cells(counts.where("model = 'train'"), DEFAULT_THRESHOLD))
    half = half.select("model", F.col("accuracy").alias("__accuracy"))
    # loss and AUC do not depend on the threshold; of the train part only the accuracy does
    out = both.join(half, "model", "left").withColumns({"accuracy": F.coalesce("__accuracy", "accuracy")})
    return {r.model: r for r in out.collect()}  # two rows


def fit_epochs(prepared: DataFrame, features: Sequence[str], folder: str, run: str = "run", label: str = "label",
               part_col: str = "part", hidden: Sequence[int] = (), n_epochs: int = 5, patience: int = 3, iterations: int = 10,
               pos_weight: int = int(POS_WEIGHT), seed: int = 42, metric: str = "val_f1") -> EpochModel:
    """Fit a feed-forward network (``hidden=()``: a logistic model) epoch by epoch and return the best epoch's model.

    Per epoch, ``iterations`` solver iterations from the weights so far; the train part gives loss, accuracy and AUC,
    the valid part loss, accuracy, AUC, precision, recall and F1. The threshold of the valid part is searched on even
    epochs and the last one and carried in between (0.5 before any). An epoch is the best so far if ``metric`` is
    strictly above all before and above 0; the fit stops after ``patience`` epochs without that. The returned model is
    the best epoch's with the *latest* threshold; if no epoch improved, it is the last epoch's.

    ``folder`` receives ``history`` (one JSON row per epoch and run; append only) and ``<run>/epoch-<k>`` (models). A run
    whose history is already there is continued after its last epoch, or returned if it is complete. Rows without a
    usable label or part take no part.
    """
    spark, features = prepared.sparkSession, list(features)
    rows = with_vector(prepared.where(F.col(label).isin(0, 1) & F.col(part_col).isin("train", "valid")), features).select(
        F.col(part_col).alias("part"), F.col(label).cast("int").alias("label"), "_fv")
    layers = [len(features), *hidden, 2]
    weights = sum((a + 1) * b for a, b in zip(layers[:-1], layers[1:]))
    rows = cut_lineage(rows)
    train = spread_rows(repeat_positives(rows.where("part = 'train'"), "label", int(pos_weight)), weights, iterations * n_epochs)

    def done() -> list:
        if not _exists(spark, f"{folder}/history"):
            return []
        return history_table(spark, folder).where(F.col("run") == run).collect()  # a row per epoch

    def verdict() -> dict:
        h = history_table(spark, folder).where(F.col("run") == run)
        return early_stop(h, metric=metric, patience=patience).first().asDict()

    past = done()
    start = len(past)
    threshold = past[-1].threshold if past else DEFAULT_THRESHOLD
    state = verdict() if past else {"stop_epoch": None}
    model = _load(f"{folder}/{run}/epoch-{start - 1}") if past and start < n_epochs and state["stop_epoch"] is None else None
    for epoch in range(start, n_epochs):
        if state["stop_epoch"] is not None:
            break
        solver = MultilayerPerceptronClassifier(featuresCol="_fv", labelCol="label", layers=layers, maxIter=iterations, seed=seed)
        if model is not None:
            solver = solver.setInitialWeights(model.weights)
        model = solver.fit(train)
        searched = epoch % 2 == 0 or epoch == n_epochs - 1
        m = evaluate_parts(model, rows, None if searched else threshold, float(pos_weight))
        t, v = m.get("train"), m.get("valid")
        threshold = v.threshold if v is not None else threshold
        model.write().overwrite().save(f"{folder}/{run}/epoch-{epoch}")
        get = lambda r, c: None if r is None else r[c]
        row = {"run": run, "epoch": epoch, "train_loss": get(t, "loss"), "train_acc": get(t, "accuracy"), "train_auc": get(t, "auc"),
               **{f"val_{c}": get(v, k) for c, k in (("loss", "loss"), ("acc", "accuracy"), ("auc", "auc"), ("precision", "precision"),
                                                     ("recall", "recall"), ("f1", "f1"))},
               "threshold": threshold, "searched": searched}
        # the row goes last: an epoch without a row was not finished and is run again
        spark.createDataFrame([(json.dumps(row),)], "value string").write.mode("append").text(f"{folder}/history")
        state = verdict()
    best = state["best_epoch"] if state["best_epoch"] >= 0 else state["epochs_run"] - 1
    return EpochModel(_load(f"{folder}/{run}/epoch-{best}"), features, best, state["final_threshold"])


def _load(path: str) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(path)


def final_evaluation(fitted: EpochModel, df: DataFrame, name: str, label: str = "label", pos_weight: float = POS_WEIGHT) -> DataFrame:
    """The evaluation record (E14) of the best epoch's model at the threshold that was carried last."""
    scored = fitted.transform(df).select(F.lit(name).alias("model"), F.col(label).alias("label"),
                                         vector_to_array("probability")[1].alias("score"))
    return E.evaluation(scored, fitted.threshold, pos_weight=pos_weight)
