"""Epoch-loop control over a history table ``(run, epoch, metrics…)`` as window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.operators.evaluate import known

DEFAULT_THRESHOLD = 0.5
# The series of a training history.
HISTORY_SERIES = ("train_loss", "train_acc", "train_auc", "val_loss", "val_acc", "val_auc",
                  "val_precision", "val_recall", "val_f1", "threshold")


def threshold_schedule(history: DataFrame, searched: str, run: str = "run", epoch: str = "epoch",
                       n_epochs: int | None = None, out: str = "threshold") -> DataFrame:
    """The threshold each epoch reports: re-searched on even epochs and on the last
    configured epoch, otherwise carried from the latest search (0.5 before any).

    ``searched`` holds what a search at that epoch returns; ``n_epochs`` defaults to
    each run's number of epochs.
    """
    w_all = Window.partitionBy(run)
    last_epoch = F.lit(n_epochs - 1) if n_epochs is not None else F.max(epoch).over(w_all)
    is_search = ((F.col(epoch) % 2) == 0) | (F.col(epoch) == last_epoch)
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (history.withColumn("searched_epoch", is_search)
            .withColumn(out, F.coalesce(F.last(F.when(F.col("searched_epoch"), known(history, searched)), ignorenulls=True)
                                        .over(upto), F.lit(DEFAULT_THRESHOLD))))


def improvement_marks(history: DataFrame, metric: str = "val_f1", run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per epoch: ``improved`` (strictly above the best so far, starting from 0.0), the last
    improved epoch (``-1`` if none) and ``since`` = epochs without improvement (K3). A null or NaN metric improves
    nothing."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = known(history, metric)
    best_before = F.greatest(F.coalesce(F.max(value).over(before), F.lit(0.0)), F.lit(0.0))
    h = history.withColumn("improved", F.coalesce(value > best_before, F.lit(False)))
    h = h.withColumn("last_improved", F.coalesce(F.max(F.when(F.col("improved"), F.col(epoch))).over(upto), F.lit(-1)))
    return h.withColumn("since", F.col(epoch) - F.col("last_improved"))


def early_stop(history: DataFrame, metric: str = "val_f1", patience: int = 3, run: str = "run",
               epoch: str = "epoch", threshold: str | None = "threshold") -> DataFrame:
    """Per run: ``stop_epoch`` (first epoch with ``patience`` epochs without improvement, null if
    none), ``epochs_run``, ``best_epoch`` (-1 if never improved) and ``best_metric`` (T6).

    Every improvement is strictly above all earlier values, so the best metric is
    the largest improved value up to the stop. When the history has a ``threshold``
    column, ``final_threshold`` is its value at the last epoch run: the final
    evaluation pairs the best epoch's model with the latest searched threshold."""
    h = improvement_marks(history, metric, run, epoch)
    # Same partitioning (run) as the marks' windows: no further shuffle before the aggregate.
    h = h.withColumn("stop_epoch", F.min(F.when(F.col("since") >= patience, F.col(epoch))).over(Window.partitionBy(run)))
    j = h.filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    aggs = [F.first("stop_epoch").alias("stop_epoch"),
            F.count(F.lit(1)).alias("epochs_run"),
            F.coalesce(F.max(F.when(F.col("improved"), F.col(epoch))), F.lit(-1)).alias("best_epoch"),
            F.max(F.when(F.col("improved"), F.col(metric))).alias("best_metric")]
    if threshold and threshold in history.columns:
        aggs.append(F.max_by(F.col(threshold), F.col(epoch)).alias("final_threshold"))
    return j.groupBy(run).agg(*aggs)


def training_curves(history: DataFrame, series: Sequence[str] = HISTORY_SERIES, run: str = "run",
                    epoch: str = "epoch") -> DataFrame:
    """Long curve data ``(run, epoch, series, value)`` ordered by run and epoch."""
    cols = [c for c in series if c in history.columns]
    long = history.select(run, epoch, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [run, epoch], cols, "series", "value")
    return long.orderBy(run, epoch, "series")
