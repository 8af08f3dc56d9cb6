"""Evaluation of scored tables ``(key, model, label, score)``, many models in one job.

Everything below starts from one partial aggregate: positive and negative counts
per (model, distinct score). Log-loss, confusion cells, precision/recall/F1, AUC,
both curves and the F1-optimal threshold are all exact functions of those counts,
so the scored table is read once and the rest works on at most one row per
distinct score. Curves need running counts in score order; those come from
``prefix.running_sums_desc`` (bucket offsets + per-bucket windows), never from a
one-task global window.

Conventions (fixed by the semantics being reproduced):
* prediction is ``score > threshold`` (strict); the curves count ``score >= t``;
* the PR curve has one point per distinct score plus the end point (precision 1,
  recall 0) with a null threshold; the ROC curve starts at (0, 0) with threshold +inf;
* F1-optimal threshold: ``f1 = 2pr/(p + r + 1e-8)`` over the points without the end
  point, ties to the lowest threshold;
* precision, recall and F1 are 0 when their denominator is 0; AUC is null for a
  single-class model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.functions.columns import bce_on_logits, bce_on_probs, sigmoid
from kindling.operators.prefix import range_buckets, running_sums_desc
from kindling.session import broadcast_if_small, cut_lineage

# Fixed value: the constant in the denominator of the threshold search's F1.
F1_SEARCH_EPS = 1e-8
DEFAULT_THRESHOLD = 0.5


def _div(a: Column, b: Column, zero=0.0) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(zero))


# --- E3 / E4 ---------------------------------------------------------------------------

def with_probability(df: DataFrame, logit: str = "logit", out: str = "score") -> DataFrame:
    """Sigmoid of a logit column."""
    return df.withColumn(out, sigmoid(logit))


def with_prediction(df: DataFrame, threshold=DEFAULT_THRESHOLD, score: str = "score", out: str = "pred",
                    inclusive: bool = False) -> DataFrame:
    """``pred = score > threshold`` (E4); ``threshold`` is a number or a column name."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    cond = F.col(score) >= t if inclusive else F.col(score) > t
    return df.withColumn(out, cond.cast("int"))


def usable(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The rows every metric counts (one rule for all): label and score neither null nor NaN."""
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    return df.filter(y.isNotNull() & ~F.isnan(y) & x.isNotNull() & ~F.isnan(x))


# --- core counts -------------------------------------------------------------------

def score_counts(scored: DataFrame, model: str = "model", label: str = "label", score: str = "score",
                 materialize: bool = False) -> DataFrame:
    """``(model, score, pos, neg)``: one row per distinct score (map-side combined).

    Label 1 counts as positive and any other label as negative; rows that are not
    :func:`usable` are left out.

    ``materialize`` checkpoints the counts into the shared checkpoint folder so that
    operators reading them several times scan the scored table once; the
    checkpoint also pins a range-partition bucket ``_bk`` per row, which the
    running sums use so that no bucket is hot however the scores are spread."""
    y = positive(label)
    counts = (usable(scored, label, score)
              .groupBy(F.col(model).alias("model"), F.col(score).cast("double").alias("score"))
              .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                   F.sum(F.when(y == 1, 0).otherwise(1)).cast("bigint").alias("neg")))
    return cut_lineage(range_buckets(counts, ["model"], "score")) if materialize else counts


def model_totals(counts: DataFrame) -> DataFrame:
    """``(model, P, N, M)``: positives, negatives and distinct scores per model."""
    return counts.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                       F.count(F.lit(1)).alias("M"))


def curve_counts(counts: DataFrame, materialize: bool = False, with_next: bool = False) -> DataFrame:
    """Counts plus running ``tp``/``fp`` (score >= this score), point index ``idx`` from the
    top, and the model totals ``P``/``N``/``M``; ``with_next`` adds the next lower point's
    counts ``pos_next``/``neg_next``. Counts without a pinned range bucket get one first (written once), so that no
    bucket is hot however the scores are spread."""
    if "_bk" not in counts.columns:
        counts = cut_lineage(range_buckets(counts, ["model"], "score"))
    c = counts.withColumn("one", F.lit(1).cast("bigint"))
    run = running_sums_desc(c, ["model"], "score", ["pos", "neg", "one"], bucket_col="_bk",
                            next_cols=["pos", "neg"] if with_next else ())
    extra = [F.col("next_pos").alias("pos_next"), F.col("next_neg").alias("neg_next")] if with_next else []
    cc = run.select("model", "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    F.col("cum_one").alias("idx"), F.col("tot_pos").alias("P"), F.col("tot_neg").alias("N"),
                    F.col("tot_one").alias("M"), *extra)
    return cut_lineage(cc) if materialize else cc


# --- E1 / E2 / E18 ----------------------------------------------------------------------

def positive(label: str = "label") -> Column:
    """1 for label 1 and 0 for any other label: the one label rule of all metrics."""
    return F.when(F.col(label).cast("double") == 1, F.lit(1)).otherwise(F.lit(0))


def log_loss(scored: DataFrame, group: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    """Mean binary cross-entropy on probabilities, logs floored at -100."""
    return usable(scored, label, score).groupBy(group).agg(F.avg(bce_on_probs(score, positive(label))).alias("log_loss"))


def weighted_log_loss(df: DataFrame, pos_weight: float = 2.0, group: str = "model", label: str = "label",
                      logit: str = "logit") -> DataFrame:
    """Mean binary cross-entropy on logits with weight on the positive term.

    The mean divides by the row count, not by the sum of weights.
    """
    return usable(df, label, logit).groupBy(group).agg(
        F.avg(bce_on_logits(logit, positive(label), pos_weight)).alias("weighted_log_loss"))


def epoch_metrics(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, model: str = "model", label: str = "label",
                  score: str = "score", pos_weight: float = 1.0) -> DataFrame:
    """Train-pass ``(model, loss, accuracy, auc, n)`` (E18): the row mean, which is what batch means weighted by batch
    size add up to, and the AUC of the pass. ``pos_weight`` weighs the loss of positive rows."""
    counts = score_counts(scored, model, label, score, materialize=True)
    return evaluation_from_counts(counts, threshold, pos_weight=pos_weight).select("model", "loss", "accuracy", "auc", "n")


# --- thresholded metrics (E5, E7, E8) ----------------------------------------------------

def _thresholds(counts: DataFrame, thresholds) -> DataFrame:
    if thresholds is None or isinstance(thresholds, (int, float)):
        t = DEFAULT_THRESHOLD if thresholds is None else float(thresholds)
        return counts.withColumn("threshold", F.lit(t))
    return counts.join(thresholds.select("model", "threshold"), "model")


def confusion_cells(counts: DataFrame, thresholds=None) -> DataFrame:
    """``(model, threshold, tn, fp, fn, tp, n)`` from score counts; thresholds is a number or a
    ``(model, threshold)`` table."""
    c = _thresholds(counts, thresholds)
    above = F.col("score") > F.col("threshold")
    return c.groupBy("model", "threshold").agg(
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.col("pos") + F.col("neg")).cast("bigint").alias("n"))


def rates(cells: DataFrame) -> DataFrame:
    """Accuracy (E5) and precision, recall, F1 of class 1 (E7) from confusion cells."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "*",
        _div(tp + tn, F.col("n")).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"))


def _cells(scored: DataFrame, thresholds) -> DataFrame:
    """Confusion cells of a scored table. A number as threshold needs four sums per model, map-side combined; a
    ``(model, threshold)`` table is joined to the per-score counts."""
    if thresholds is not None and not isinstance(thresholds, (int, float)):
        return confusion_cells(score_counts(scored), thresholds)
    t = DEFAULT_THRESHOLD if thresholds is None else float(thresholds)
    above, pos = F.col("score").cast("double") > t, positive() == 1
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return usable(scored).groupBy("model").agg(
        F.lit(t).alias("threshold"), n(~above & ~pos).alias("tn"), n(above & ~pos).alias("fp"),
        n(~above & pos).alias("fn"), n(above & pos).alias("tp"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(scored: DataFrame, thresholds=None) -> DataFrame:
    """2 × 2 confusion matrix as rows ``(model, label, pred, n)``; empty cells are 0."""
    cells = _cells(scored, thresholds)
    grid = F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.lit(0).alias("pred"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("label"), F.lit(1).alias("pred"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(0).alias("pred"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(1).alias("pred"), F.col("tp").alias("n"))))
    return cells.select("model", grid.alias("c")).select("model", "c.label", "c.pred", "c.n")


def binary_metrics(scored: DataFrame, thresholds=None) -> DataFrame:
    """``(model, threshold, accuracy, precision, recall, f1, tn, fp, fn, tp, n)``."""
    return rates(_cells(scored, thresholds))


# --- ranking metrics (E6, E9–E13) ---------------------------------------------------------

def _wide(x) -> Column:
    """A count as a decimal: products and sums of counts pass the bigint range from some 10**9 rows on."""
    return x.cast("decimal(19,0)")


def _share_of_pairs(numerator: Column) -> Column:
    """``numerator / (2 P N)``, null for a single-class model."""
    return F.when((F.first("P") > 0) & (F.first("N") > 0),
                  F.sum(numerator).cast("double") / (F.lit(2.0) * F.first("P") * F.first("N")))


def _auc_expr() -> Column:
    return _share_of_pairs(_wide(F.col("pos")) * _wide(F.lit(2) * (F.col("N") - F.col("fp")) + F.col("neg")))


def auc_from_counts(counts: DataFrame) -> DataFrame:
    """ROC AUC with ties counted half (E6), exact in integer arithmetic:
    ``Σ pos·(2·(N - fp) + neg) / (2·P·N)`` where ``fp`` counts negatives at or above the score."""
    return curve_counts(counts).groupBy("model").agg(_auc_expr().alias("auc"))


def _counts(scored: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Prepared per-score counts if the caller shares them between metrics, else those of ``scored``."""
    return counts if counts is not None else score_counts(scored, materialize=True)


def auc(scored: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    return auc_from_counts(_counts(scored, counts))


def pr_curve(scored: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """Precision-recall curve (E9): ``(model, threshold, precision, recall)``."""
    counts = _counts(scored, counts)
    return pr_points(curve_counts(counts), ends_from=model_totals(counts))


def pr_points(cc: DataFrame, ends_from: DataFrame | None = None) -> DataFrame:
    """PR points of a curve-count table, plus the end point per model of ``ends_from``."""
    recall = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P"))
    pts = cc.select("model", F.col("score").alias("threshold"),
                    _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), recall.alias("recall"))
    if ends_from is None:
        return pts
    ends = ends_from.select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(ends)


def roc_curve(scored: DataFrame | None, drop_intermediate: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """ROC curve (E10): ``(model, threshold, fpr, tpr)`` with the (0, 0) start point at +inf.

    ``drop_intermediate`` removes points collinear with both neighbours (a point is
    kept when the next lower point's counts differ from its own), first and last kept.
    The next point's counts come from the running-sum pass (``lead`` within a bucket,
    the next bucket's top point across buckets): no self-join, no global window.
    """
    counts = _counts(scored, counts)
    cc = curve_counts(counts, with_next=drop_intermediate)
    if drop_intermediate:
        cc = cc.filter((F.col("M") <= 2) | (F.col("idx") == 1) | F.col("pos_next").isNull()
                       | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")))
    fpr = F.when(F.col("N") > 0, F.col("fp") / F.col("N"))
    tpr = F.when(F.col("P") > 0, F.col("tp") / F.col("P"))
    pts = cc.select("model", F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    starts = model_totals(counts).select(
        "model", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(starts)


def trapezoid_auc(scored: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule.

    Each point's predecessor on the curve is the next higher score, whose running
    counts are this point's minus its own counts, so every trapezoid
    ``(fp - fp_prev)/N · (tp + tp_prev)/(2P)`` is computed row by row.
    """
    cc = curve_counts(_counts(scored, counts))
    num = _wide(F.col("neg")) * _wide(F.lit(2) * F.col("tp") - F.col("pos"))
    return cc.groupBy("model").agg(_share_of_pairs(num).alias("trapezoid_auc"))


def mean_precision(scored: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """Mean of the PR curve's precision values including the end point.

    This is the plain mean of the points, not the area under the curve."""
    return pr_curve(scored, counts).groupBy("model").agg(F.avg("precision").alias("mean_precision"))


def _best_expr() -> Column:
    p, r = F.col("_p"), F.col("_r")
    f1 = F.lit(2.0) * (p * r) / (p + r + F.lit(F1_SEARCH_EPS))
    return F.max_by(F.struct(F.col("score").alias("threshold"), f1.alias("search_f1"),
                             (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp")),
                    F.struct(f1, -F.col("score")))


def _with_pr(cc: DataFrame) -> DataFrame:
    recall = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P"))
    return cc.withColumn("_p", _div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("_r", recall)


def best_threshold_from_counts(cc: DataFrame) -> DataFrame:
    """F1-optimal threshold per model (E13, K2): highest search F1, lowest threshold on ties."""
    best = _with_pr(cc).groupBy("model").agg(_best_expr().alias("b"))
    return best.select("model", F.coalesce(F.col("b.threshold"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
                       F.col("b.search_f1").alias("search_f1"))


def best_threshold(scored: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    return best_threshold_from_counts(curve_counts(_counts(scored, counts)))


# --- E14 ---------------------------------------------------------------------------------

def evaluation(scored: DataFrame, threshold=None, find_best: bool = False, pos_weight: float = 1.0) -> DataFrame:
    """Full evaluation record per model.

    ``threshold`` is a number, a ``(model, threshold)`` table or None (0.5);
    ``find_best`` searches the F1-optimal threshold instead; ``pos_weight`` weighs the loss of
    positive rows (the mean still divides by the row count). Returns ``(model, n, loss, accuracy,
    auc, precision, recall, f1, tn, fp, fn, tp, threshold)``.

    The scored table is read once (per-score counts, checkpointed).
    """
    return evaluation_from_counts(score_counts(scored, materialize=True), threshold, find_best, pos_weight)


def evaluation_from_counts(counts: DataFrame, threshold=None, find_best: bool = False,
                           pos_weight: float = 1.0) -> DataFrame:
    """:func:`evaluation` of prepared per-score counts.

    One map-side combined aggregate per model over the running counts gives everything: the counts above a fixed
    threshold are conditional sums, those above the searched one are the running counts at its point without the
    point's own. Only a threshold table is joined, by model, after its size is checked."""
    cc = _with_pr(curve_counts(counts))
    if find_best or threshold is None or isinstance(threshold, (int, float)):
        cc = cc.withColumn("threshold", F.lit(DEFAULT_THRESHOLD if threshold is None else threshold).cast("double")
                           if not find_best else F.lit(None).cast("double"))
    else:
        cc = cc.join(broadcast_if_small(threshold.select("model", F.col("threshold").cast("double"))), "model")
    above = F.col("score") > F.col("threshold")
    loss = (F.lit(float(pos_weight)) * F.col("pos") * bce_on_probs(F.col("score"), F.lit(1))
            + F.col("neg") * bce_on_probs(F.col("score"), F.lit(0)))
    per_model = cc.groupBy("model").agg(
        _auc_expr().alias("auc"), _best_expr().alias("b"), F.first("P").alias("P"), F.first("N").alias("N"),
        F.max("threshold").alias("t"), F.sum(loss).alias("_loss"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("bigint").alias("_fp"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("bigint").alias("_tp"))
    fp, tp, t = ("b.fp", "b.tp", "b.threshold") if find_best else ("_fp", "_tp", "t")
    cells = per_model.select("model", "auc", F.col(t).alias("threshold"), (F.col("N") - F.col(fp)).alias("tn"),
                             F.col(fp).alias("fp"), (F.col("P") - F.col(tp)).alias("fn"), F.col(tp).alias("tp"),
                             (F.col("P") + F.col("N")).alias("n"), "_loss")
    out = rates(cells).withColumn("loss", F.col("_loss") / F.col("n"))
    return out.select("model", "n", "loss", "accuracy", "auc", "precision", "recall", "f1",
                      "tn", "fp", "fn", "tp", "threshold")


# --- E15–E17, K1 ---------------------------------------------------------------------------

COMPARISON_METRICS = ("accuracy", "auc", "precision", "recall", "f1")


def model_comparison(evaluations: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Comparison table (E15): ``(model, accuracy, auc, precision, recall, f1, training_time,
    parameters)``. ``meta`` supplies ``(model, training_time, parameters)``."""
    base = evaluations.select("model", *COMPARISON_METRICS)
    if meta is None:
        return base.withColumn("training_time", F.lit(None).cast("double")).withColumn(
            "parameters", F.lit(None).cast("bigint"))
    return base.join(meta.select("model", F.col("training_time").cast("double"),
                                 F.col("parameters").cast("bigint")), "model", "left")


def comparison_display(comparison: DataFrame) -> DataFrame:
    """Display copy: metrics and time with 4 decimals, parameters with thousands separators."""
    cols = [F.col("model")]
    for c in (*COMPARISON_METRICS, "training_time"):
        cols.append(F.format_number(F.col(c), 4).alias(c))
    cols.append(F.format_number(F.col("parameters"), 0).alias("parameters"))
    return comparison.select(*cols)


def metric_bars(comparison: DataFrame) -> DataFrame:
    """Bar-chart data (E16): ``(model, metric, value)`` for the five metrics."""
    return comparison.unpivot("model", list(COMPARISON_METRICS), "metric", "value")


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as null (only floating types have NaN)."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if df.schema[name].dataType.typeName() in ("float", "double") else c


def top_n(df: DataFrame, by: str, n: int, tie: str | None = None) -> DataFrame:
    """Descending sort and first ``n`` rows (K1); ``tie`` breaks equal values ascending, null and NaN come last.
    Planned as a per-partition top-n merged at the end, not a full sort."""
    order = [known(df, by).desc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(n)


def first_max_per_group(df: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    """Arg-max per group with ties to the smallest ``tie`` value (K2), as an aggregate."""
    cols = [c for c in df.columns if c != group]
    best = df.groupBy(group).agg(F.max_by(F.struct(*cols), F.struct(F.col(by), -F.col(tie))).alias("_b"))
    return best.select(group, "_b.*")

