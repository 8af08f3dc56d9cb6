"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every computed double is rounded (6 decimals) so the DuckDB oracle can compare
values exactly; counts are bigint. The SQL twins live in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions.columns import sigmoid
from kindling.functions import arrays as AR
from kindling.operators import catalog as C
from kindling.operators import curves as CV
from kindling.operators import derive as DV
from kindling.operators import epochs as EP
from kindling.operators import fit as FT
from kindling.operators import history as H
from kindling.operators import importance as I
from kindling.operators import scoring as S
from kindling.operators import evaluate as E
from kindling.operators import prepare as P
from kindling.plans import tables as T
from kindling.session import cut_lineage, scratch_root
from kindling.sources.io import save_model, saved_model, write_csv, write_report

R = 6  # rounding digits for computed doubles


def _round(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), R))
    return df


# --- preparation -----------------------------------------------------------------------------

def _events_parts(spark, sf):
    return P.time_split(T.events_labelled(spark, sf), "ts", T.EVENTS_CUT)


def q_table_profile(spark, sf):
    """Rows and columns of the table before and after each preparation step."""
    raw = T.events_labelled(spark, sf)
    parts = P.time_split(raw, "ts", T.EVENTS_CUT)
    bal = P.balanced_sample(parts, "event_id", "label")
    stages = [("split", P.table_profile(parts, "part", with_all=True)), ("balanced", P.table_profile(bal, "part"))]
    out = None
    for name, prof in stages:
        stage = F.when(F.col("part") == "all", "raw").otherwise(name)
        prof = prof.select(stage.alias("stage"), "part", F.col("n_rows").cast("bigint"), "n_cols")
        out = prof if out is None else out.unionByName(prof)
    return out


def q_class_counts(spark, sf):
    return P.class_counts(_events_parts(spark, sf), "label").select("part", "label", F.col("n").cast("bigint"))


def q_time_split(spark, sf):
    return _events_parts(spark, sf).select("event_id", "part")


def _events_balanced(spark, sf, cap=None, materialize=False):
    bal = P.balanced_sample(_events_parts(spark, sf), "event_id", "label", cap=cap)
    return cut_lineage(bal) if materialize else bal


def q_balanced_sample(spark, sf):
    return _events_balanced(spark, sf).select("event_id", "part", "label")


def _orders_parts(spark, sf):
    return P.time_split(T.orders_labelled(spark, sf), "o_orderdate", T.ORDERS_CUT)


def q_balanced_sample_capped(spark, sf):
    return P.balanced_sample(_orders_parts(spark, sf), "o_orderkey", "label", cap=1000).select(
        "o_orderkey", "part", "label")


def q_shuffle_order(spark, sf):
    return P.shuffle_order(_events_balanced(spark, sf), "event_id").select("event_id", "part", "label", "shuffle_key")


EVENT_FEATURES = ["value", "hour"]
ORDER_FEATURES = ["o_totalprice", "priority", "month"]


def q_scaler_params(spark, sf):
    train = _events_balanced(spark, sf, materialize=True).filter(F.col("part") == P.TRAIN)
    return _round(P.fit_scaler(train, EVENT_FEATURES), ["mean", "std"])


def q_scaler_transform(spark, sf):
    bal = _events_balanced(spark, sf, materialize=True)
    params = P.fit_scaler(bal.filter(F.col("part") == P.TRAIN), EVENT_FEATURES)
    out = P.scaler_transform(bal, params, EVENT_FEATURES)
    return _round(out.select("event_id", "part", "label", *EVENT_FEATURES), EVENT_FEATURES)


def q_prepared(spark, sf):
    prepared, _ = P.prepare(T.orders_labelled(spark, sf), "o_orderkey", "label", "o_orderdate", T.ORDERS_CUT,
                            ORDER_FEATURES, cap=None, seed=42)
    return _round(prepared.select("o_orderkey", "part", "label", *ORDER_FEATURES, "shuffle_key"), ORDER_FEATURES)


# --- evaluation --------------------------------------------------------------------------------

def _scored(spark, sf):
    return T.events_scored(spark, sf)


def q_probabilities(spark, sf):
    """Sigmoid of the logit table."""
    p = E.with_probability(T.events_logits(spark, sf), "logit", "score")
    return _round(p.select("key", "model", "label", "score"), ["score"])


def q_predictions(spark, sf):
    """Strict thresholded predictions at 0.5."""
    return E.with_prediction(_scored(spark, sf), 0.5).select("key", "model", "label", "score", "pred")


def q_log_loss(spark, sf):
    return _round(E.log_loss(_scored(spark, sf)), ["log_loss"])


def q_weighted_log_loss(spark, sf):
    return _round(E.weighted_log_loss(T.events_logits(spark, sf), pos_weight=2.0), ["weighted_log_loss"])


def q_accuracy(spark, sf):
    m = E.binary_metrics(_scored(spark, sf), 0.5)
    return _round(m.select("model", "accuracy"), ["accuracy"])


def q_confusion(spark, sf):
    return E.confusion_matrix(_scored(spark, sf), 0.5)


def q_binary_metrics(spark, sf):
    m = E.binary_metrics(_scored(spark, sf), 0.5)
    return _round(m.select("model", "threshold", "precision", "recall", "f1", "tn", "fp", "fn", "tp"),
                  ["precision", "recall", "f1"])


def q_epoch_metrics(spark, sf):
    """Train-part loss, accuracy and AUC per model (E18) at threshold 0.5."""
    scored = T.events_scored(spark, sf, before=T.EVENTS_CUT)  # train part: ts < cut, pushed to the scan
    return _round(E.epoch_metrics(scored, 0.5), ["loss", "accuracy", "auc"])


def q_auc(spark, sf):
    return _round(E.auc(_scored(spark, sf)), ["auc"])


def q_pr_curve(spark, sf):
    return _round(E.pr_curve(_scored(spark, sf)), ["precision", "recall"])


def q_roc_curve(spark, sf):
    return _round(E.roc_curve(_scored(spark, sf)), ["fpr", "tpr"])


def q_roc_reduced(spark, sf):
    return _round(E.roc_curve(_scored(spark, sf), drop_intermediate=True), ["fpr", "tpr"])


def q_trapezoid_auc(spark, sf):
    return _round(E.trapezoid_auc(_scored(spark, sf)), ["trapezoid_auc"])


def q_mean_precision(spark, sf):
    return _round(E.mean_precision(_scored(spark, sf)), ["mean_precision"])


def q_best_threshold(spark, sf):
    return _round(E.best_threshold(_scored(spark, sf)), ["search_f1"])


EVAL_DOUBLES = ["loss", "accuracy", "auc", "precision", "recall", "f1"]


def q_evaluation(spark, sf):
    return _round(E.evaluation(_scored(spark, sf), find_best=True), EVAL_DOUBLES)


def q_evaluation_weighted(spark, sf):
    """Evaluation record at threshold 0.5 with the benchmark's loss: positive rows weigh 2."""
    return _round(E.evaluation(_scored(spark, sf), 0.5, pos_weight=2.0), EVAL_DOUBLES)


def _model_meta(spark):
    """Per-model metadata the comparison table takes as given: fit time 0, two parameters."""
    return spark.createDataFrame([(n, 0.0, 2) for n, _, _ in T.SCORE_MODELS],
                                 "model string, training_time double, parameters bigint")


def q_model_comparison(spark, sf):
    ev = E.evaluation(_scored(spark, sf), find_best=True)
    return _round(E.model_comparison(ev, _model_meta(spark)), list(E.COMPARISON_METRICS))


def q_metric_bars(spark, sf):
    ev = E.evaluation(_scored(spark, sf), find_best=True)
    return _round(E.metric_bars(E.model_comparison(ev)), ["value"])


# --- flagship ----------------------------------------------------------------------------------

# Fixed weights of the flagship's logistic score on the scaled features.
FLAGSHIP_WEIGHTS = {"value": 0.8, "hour": 0.1}
FLAGSHIP_BIAS = -0.2


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """events → split → balance → scale (fit on balanced train) → fixed-weight logistic
    score on the balanced valid part → F1-optimal threshold → evaluation record."""
    bal = _events_balanced(spark, sf, materialize=True)
    params = P.fit_scaler(bal.filter(F.col("part") == P.TRAIN), EVENT_FEATURES)
    scaled = P.scaler_transform(bal.filter(F.col("part") == P.VALID), params, EVENT_FEATURES)
    logit = F.lit(FLAGSHIP_BIAS)
    for c, w in FLAGSHIP_WEIGHTS.items():
        logit = logit + F.lit(w) * F.col(c)
    scored = scaled.select(F.col("event_id").alias("key"), F.lit("flagship").alias("model"), "label",
                           F.round(sigmoid(logit), 4).alias("score"))
    return _round(E.evaluation(scored, find_best=True), EVAL_DOUBLES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "table_profile": q_table_profile,
    "class_counts": q_class_counts,
    "time_split": q_time_split,
    "balanced_sample": q_balanced_sample,
    "balanced_sample_capped": q_balanced_sample_capped,
    "shuffle_order": q_shuffle_order,
    "scaler_params": q_scaler_params,
    "scaler_transform": q_scaler_transform,
    "prepared": q_prepared,
    "probabilities": q_probabilities,
    "predictions": q_predictions,
    "log_loss": q_log_loss,
    "weighted_log_loss": q_weighted_log_loss,
    "accuracy": q_accuracy,
    "confusion": q_confusion,
    "binary_metrics": q_binary_metrics,
    "epoch_metrics": q_epoch_metrics,
    "auc": q_auc,
    "pr_curve": q_pr_curve,
    "roc_curve": q_roc_curve,
    "roc_reduced": q_roc_reduced,
    "trapezoid_auc": q_trapezoid_auc,
    "mean_precision": q_mean_precision,
    "best_threshold": q_best_threshold,
    "evaluation": q_evaluation,
    "evaluation_weighted": q_evaluation_weighted,
    "model_comparison": q_model_comparison,
    "metric_bars": q_metric_bars,
    "flagship": flagship,
}


# --- catalog -----------------------------------------------------------------------------------


def _lineitem_long(spark, sf):
    """The long lineitem features and the catalog of their groups."""
    li = T.lineitem_labelled(spark, sf)
    cat = C.feature_group_catalog(C.names_frame(spark, T.LINEITEM_FEATURES), T.LINEITEM_GROUPS, exclude=("label",))
    return C.to_long(li, ["l_orderkey"], T.LINEITEM_FEATURES), cat


def q_feature_groups(spark, sf):
    return C.tag(*_lineitem_long(spark, sf)).select("l_orderkey", "feature", "value", "group")


def q_group_profile(spark, sf):
    return _round(C.group_profile(*_lineitem_long(spark, sf)), ["mean", "std", "min", "max"])


def _daily_filled(spark, sf):
    """Gap-free daily grid per user with linearly interpolated values."""
    grid = DV.daily_grid(T.events_daily(spark, sf), "user_id", "day", ["value", "n_events"])
    filled = DV.interpolate_linear(grid, "user_id", "day", "value", out="value_filled")
    return filled.select("user_id", "day", "value", "value_filled",
                         F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"))


LAG_DAYS = (1, 2, 7)


def _lagged(spark, sf):
    d = _daily_filled(spark, sf).select("user_id", "day", F.col("value_filled").alias("value"), "n_events")
    d = DV.lag_features(d, "user_id", "day", ["value"], LAG_DAYS)
    return DV.lag_features(d, "user_id", "day", ["n_events"], (1,))


def q_interpolated(spark, sf):
    return _round(_daily_filled(spark, sf), ["value", "value_filled"])


def q_lag_features(spark, sf):
    cols = ["value"] + [f"value_lag_{d}" for d in LAG_DAYS] + ["n_events", "n_events_lag_1"]
    return _round(_lagged(spark, sf).select("user_id", "day", *cols), [c for c in cols if c.startswith("value")])


def q_lag_groups(spark, sf):
    lagged = _lagged(spark, sf)
    names = [c for c in lagged.columns if c not in ("user_id", "day")]
    cat = C.lag_catalog(C.names_frame(spark, names))
    long = C.to_long(lagged, ["user_id", "day"], names)
    return _round(C.tag(long, cat).select("user_id", "day", "feature", "value", "lag"), ["value"])


def q_lag_profile(spark, sf):
    """Profile of the lag features per lag (F3 by lag)."""
    lagged = _lagged(spark, sf)
    names = [c for c in lagged.columns if c not in ("user_id", "day")]
    long = C.to_long(lagged, ["user_id", "day"], names)
    return _round(C.group_profile(long, C.lag_catalog(C.names_frame(spark, names)), "lag"), ["mean", "std", "min", "max"])


def q_feature_rank(spark, sf):
    li = T.lineitem_labelled(spark, sf)
    return _round(C.feature_rank(li, T.LINEITEM_FEATURES, "label", top=3).select("feature", "corr", "importance"),
                  ["corr", "importance"])


def q_standard_names(spark, sf):
    cust = T.table(spark, sf, "customer")
    segs = DV.pivot_values(cust, "c_mktsegment")
    wide = cust.groupBy("c_nationkey").pivot("c_mktsegment", segs).agg(F.round(F.avg("c_acctbal"), R))
    return DV.standardise_names(wide)


def q_source_merge(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment",
                                              F.col("c_nationkey").alias("n_nationkey"))
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return DV.merge_sources(o, (c, ["o_custkey"], False), (n, ["n_nationkey"], True)).select(
        "o_orderkey", "o_custkey", "c_name", "c_mktsegment", "n_name", "o_totalprice")


# --- history (T6, K3, E17) ----------------------------------------------------------------------

def _history(spark, sf):
    h = T.events_history(spark, sf)
    return H.threshold_schedule(h, "val_precision")


def q_early_stop(spark, sf):
    return _round(H.early_stop(_history(spark, sf), "val_f1", patience=3), ["best_metric", "final_threshold"])


def q_threshold_carry(spark, sf):
    return _round(_history(spark, sf).select("run", "epoch", "searched_epoch", "threshold"), ["threshold"])


def q_training_curves(spark, sf):
    return _round(H.training_curves(_history(spark, sf)), ["value"])


QUERIES.update({
    "feature_groups": q_feature_groups,
    "group_profile": q_group_profile,
    "lag_groups": q_lag_groups,
    "lag_profile": q_lag_profile,
    "feature_rank": q_feature_rank,
    "interpolated": q_interpolated,
    "lag_features": q_lag_features,
    "standard_names": q_standard_names,
    "source_merge": q_source_merge,
    "early_stop": q_early_stop,
    "threshold_carry": q_threshold_carry,
    "training_curves": q_training_curves,
})


# --- scoring (N1–N9, F4) --------------------------------------------------------------------------


def _emb(spark, sf):
    return T.embeddings(spark, sf)


def _long_array(df, key, col, pos="pos", val="value"):
    return df.select(key, F.posexplode(col).alias(pos, val))


def q_entropy_score(spark, sf):
    out = S.entropy_scores(_emb(spark, sf), "embedding", n_landcover=4, k=1.0, alpha=T.ENTROPY_ALPHA)
    return _round(out.select("vec_id", "entropy_score"), ["entropy_score"])


def q_dense_layer(spark, sf):
    out = S.dense_layer(_emb(spark, sf), "embedding", T.DENSE_W, T.DENSE_B, act="relu")
    return _round(_long_array(out, "vec_id", "hidden", "unit", "h"), ["h"])


def q_batch_norm(spark, sf):
    li = T.table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _round(S.batch_norm(li, cols).select("l_orderkey", *cols), cols)


def q_layer_norm(spark, sf):
    out = S.layer_norm(_emb(spark, sf), "embedding", out="normed")
    return _round(_long_array(out, "vec_id", "normed"), ["value"])


def q_conv_features(spark, sf):
    out = S.conv_features(_emb(spark, sf), "embedding", T.CONV_KERNELS)
    per_filter = out.select("vec_id", F.posexplode("conv").alias("filter", "ys"))
    return _round(per_filter.select("vec_id", "filter", F.posexplode("ys").alias("pos", "value")), ["value"])


def q_additive_score(spark, sf):
    li = T.table(spark, sf, "lineitem")
    bins = {f: S.Bins(*v) for f, v in T.ADDITIVE_BINS.items()}
    out = S.additive_scores(li, bins, T.ADDITIVE_SHAPES, T.ADDITIVE_BIAS)
    return _round(out.select("l_orderkey", "additive_score"), ["additive_score"])


def q_curve_score(spark, sf):
    """Additive score with curves between knots (N6), the weights of the bins as values at the knots."""
    li = T.table(spark, sf, "lineitem")
    names = list(T.CURVE_KNOTS)
    curves = CV.Curves(names, [np.array(T.CURVE_KNOTS[f]) for f in names], [np.array(T.ADDITIVE_SHAPES[f]) for f in names],
                       T.ADDITIVE_BIAS)
    # the values are multiples of 5e-8, so rounding to 8 digits meets no ties
    return CV.curve_scores(li.select("l_orderkey", *names), curves).select(
        "l_orderkey", (F.round("curve_score", 8) + F.lit(0.0)).alias("curve_score"))


def q_branch_concat(spark, sf):
    out = S.branch_concat(_emb(spark, sf), "embedding", T.BRANCH_W, T.BRANCH_B, T.RESIDUAL_W, act="relu")
    return _round(_long_array(out, "vec_id", "branches"), ["value"])


def q_feature_slices(spark, sf):
    e = _emb(spark, sf)
    sl = AR.feature_slices("embedding", 4)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("slice"), s.alias("xs")) for i, s in enumerate(sl)]))
    out = e.select("vec_id", parts.alias("p")).select(
        "vec_id", "p.slice", F.size("p.xs").alias("n"), AR.array_sum("p.xs").alias("total"))
    return _round(out, ["total"])


def q_frozen_features(spark, sf):
    """Features of a frozen block with weights of an integer formula, one row per position."""
    out = S.frozen_block_features(_emb(spark, sf), "embedding", S.FrozenBlock(**T.frozen_weights()), key="vec_id")
    return out.select("vec_id", F.posexplode("frozen").alias("pos", "v")).select(
        "vec_id", "pos", (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("value"))


def q_batch_score(spark, sf):
    """Scores of a feed-forward network with weights of an integer formula."""
    net = S.DenseNet(T.network_layers())
    return _round(S.batch_score(_emb(spark, sf), "embedding", net, key="vec_id", model_name="ffn", label="target"), ["score"])


def _opened_in_tasks(spark, model):
    path = f"{scratch_root(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    return saved_model(path)


def q_frozen_features_saved(spark, sf):
    """N7 with the block's weights opened by the tasks from shared storage."""
    block = _opened_in_tasks(spark, S.FrozenBlock(**T.frozen_weights()))
    out = S.frozen_block_features(_emb(spark, sf), "embedding", block, key="vec_id")
    return out.select("vec_id", F.posexplode("frozen").alias("pos", "v")).select(
        "vec_id", "pos", (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("value"))


def q_batch_score_saved(spark, sf):
    """N8 with the network's weights opened by the tasks from shared storage."""
    net = _opened_in_tasks(spark, S.DenseNet(T.network_layers()))
    return _round(S.batch_score(_emb(spark, sf), "embedding", net, key="vec_id", model_name="ffn", label="target"), ["score"])


def q_assembled(spark, sf):
    """The assembled feature vector (P11), one row per position."""
    li = P.assemble(T.lineitem_labelled(spark, sf), T.LINEITEM_FEATURES)
    return li.select("l_orderkey", F.posexplode("features").alias("pos", "v")).select(
        "l_orderkey", "pos", F.round(F.col("v").cast("double"), 2).alias("value"))


def _scratch(spark, name):
    import uuid

    from kindling.session import scratch_root

    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def q_csv_sink(spark, sf):
    """The comparison table written as CSV (S3) and read back."""
    table, path = q_model_comparison(spark, sf), _scratch(spark, "csv")
    write_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


def q_report_sink(spark, sf):
    """The run report as JSON lines (S4), appended twice under two run ids, and read back."""
    bars, path = q_metric_bars(spark, sf), _scratch(spark, "report")
    for run in ("a", "b"):
        write_report(bars, path, run)
    return spark.read.schema("model string, metric string, value double, run_id string").json(path)


def q_comparison_display(spark, sf):
    """The display copy of the comparison table."""
    return E.comparison_display(q_model_comparison(spark, sf))


QUERIES.update({
    "entropy_score": q_entropy_score,
    "dense_layer": q_dense_layer,
    "batch_norm": q_batch_norm,
    "layer_norm": q_layer_norm,
    "conv_features": q_conv_features,
    "additive_score": q_additive_score,
    "curve_score": q_curve_score,
    "branch_concat": q_branch_concat,
    "feature_slices": q_feature_slices,
    "frozen_features": q_frozen_features,
    "batch_score": q_batch_score,
    "frozen_features_saved": q_frozen_features_saved,
    "batch_score_saved": q_batch_score_saved,
    "assembled": q_assembled,
    "comparison_display": q_comparison_display,
    "csv_sink": q_csv_sink,
    "report_sink": q_report_sink,
})


# --- fitting (T1–T5) -----------------------------------------------------------------------------


def _events_prepared(spark, sf):
    ev = T.events_labelled(spark, sf)
    prepared, _ = P.prepare(ev, "event_id", "label", "ts", T.EVENTS_CUT, EVENT_FEATURES)
    return prepared  # a projection of the checkpointed sample: cheap to read for every fit


def _fit_one(name):
    def q(spark, sf):
        prepared = _events_prepared(spark, sf)
        evals, _ = FT.fit_and_evaluate(prepared, {name: FT.DEFAULT_SPECS[name]}, EVENT_FEATURES, "event_id")
        return _round(evals, EVAL_DOUBLES)

    q.__name__ = f"q_fit_{name}"
    q.__doc__ = f"Prepare events, fit the {name} model on the train part, evaluate on the valid part."
    return q


def q_fit_curves(spark, sf):
    """Additive model with continuous shape functions (T3), evaluated on the valid part."""
    evals, _ = FT.fit_and_evaluate(_events_prepared(spark, sf), {"curves": lambda t, f, k, y: CV.fit_curves(t, f, y)},
                                   EVENT_FEATURES, "event_id")
    return _round(evals, EVAL_DOUBLES)


def q_fit_all(spark, sf):
    """Prepare once, fit every model, evaluate each, and return the comparison table (T5)."""
    prepared = _events_prepared(spark, sf)
    _, comparison = FT.fit_and_evaluate(prepared, FT.DEFAULT_SPECS, EVENT_FEATURES, "event_id")
    return comparison


QUERIES.update({
    "fit_logistic": _fit_one("logistic"),
    "fit_mlp": _fit_one("mlp"),
    "fit_additive": _fit_one("additive"),
    "fit_frozen_head": _fit_one("frozen_head"),
    "fit_curves": q_fit_curves,
    "fit_all": q_fit_all,
})


# --- epoch-wise fit, importance, moments of wide tables, long places, as-of merge ---------------------

def _epoch_fit(spark, sf):
    """A small network fitted epoch by epoch on the prepared events; its folder holds history and models."""
    folder = f"{scratch_root(spark)}/epochs-{uuid.uuid4().hex}"
    prepared = _events_prepared(spark, sf)
    fitted = EP.fit_epochs(prepared, EVENT_FEATURES, folder, run="mlp", hidden=(16, 8), n_epochs=5, patience=3, iterations=10)
    return prepared, fitted, folder


def q_fit_epochs(spark, sf):
    """Training curves (E17) of the history that the fit wrote."""
    _, _, folder = _epoch_fit(spark, sf)
    return _round(H.training_curves(EP.history_table(spark, folder)), ["value"])


def q_fit_epochs_final(spark, sf):
    """The best epoch's model on the valid part, at the threshold carried last."""
    prepared, fitted, _ = _epoch_fit(spark, sf)
    out = EP.final_evaluation(fitted, prepared.where(F.col("part") == P.VALID), "mlp")
    return _round(out, EVAL_DOUBLES).withColumn("best_epoch", F.lit(fitted.epoch))


IMPORTANCE_FEATURES = ("o_totalprice", "priority", "month")


def _order_score(df):
    """A fixed model of the orders that does not use the month."""
    z = (F.col("o_totalprice") - 150000.0) / 100000.0 + (F.col("priority") - 3.0) * 0.2
    return df.withColumn("score", F.round(sigmoid(z), 4))


def q_permutation_importance(spark, sf):
    out = I.permutation_importance(T.orders_labelled(spark, sf), _order_score, IMPORTANCE_FEATURES, "o_orderkey")
    return _round(out, ["auc", "auc_permuted", "importance"])


def q_fit_importance(spark, sf):
    """Importance of the features of a fitted logistic model, on the valid part."""
    prepared = _events_prepared(spark, sf)
    model = FT.fit_logistic(prepared.where(F.col("part") == P.TRAIN), EVENT_FEATURES)

    def score(df):
        return model.transform(df).withColumn("score", FT.vector_to_array("probability")[1])

    valid = prepared.where(F.col("part") == P.VALID)
    return _round(I.permutation_importance(valid, score, EVENT_FEATURES, "event_id"), ["auc", "auc_permuted", "importance"])


def q_wide_profile(spark, sf):
    li = T.lineitem_labelled(spark, sf)
    _, cat = _lineitem_long(spark, sf)
    return _round(C.group_profile_wide(li, T.LINEITEM_FEATURES, cat), ["mean", "std", "min", "max"])


def _long_filled(spark, sf):
    grid = DV.daily_grid(T.events_daily(spark, sf), "user_id", "day", ["value", "n_events"])
    filled = DV.interpolate_linear(grid, "user_id", "day", "value", out="value_filled", long_places=True)
    return filled.select("user_id", "day", "value", "value_filled", F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"))


def q_interpolated_long(spark, sf):
    """D2 with known values carried across ranges of (place, day)."""
    return _round(_long_filled(spark, sf), ["value", "value_filled"])


def q_lag_features_long(spark, sf):
    """D3 with the last rows of a range carried to the next."""
    d = _long_filled(spark, sf).select("user_id", "day", F.col("value_filled").alias("value"), "n_events")
    d = DV.lag_features(d, "user_id", "day", ["value", "n_events"], LAG_DAYS, long_places=True)
    cols = ["value"] + [f"value_lag_{k}" for k in LAG_DAYS] + ["n_events", "n_events_lag_1"]
    return _round(d.select("user_id", "day", *cols), [c for c in cols if c.startswith("value")])


def q_source_asof(spark, sf):
    """Each purchase with the user's latest click and error of the day before it."""
    ev = T.table(spark, sf, "events")
    kind = lambda k: ev.where(F.col("event_type") == k).select("user_id", "ts", "value")
    base = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    out = DV.merge_asof(base, ("click", kind("click"), ["value"]), ("error", kind("error"), ["value"]), place="user_id", time="ts",
                        max_age="1 day")
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit(T.EVENTS_DAY0)).cast("int").alias(c.replace("_ts", "_day"))
    return out.select("event_id", "user_id", day("click_ts"), F.round("click_value", R).alias("click_value"), day("error_ts"),
                      F.round("error_value", R).alias("error_value"))


QUERIES.update({
    "fit_epochs": q_fit_epochs,
    "fit_epochs_final": q_fit_epochs_final,
    "permutation_importance": q_permutation_importance,
    "fit_importance": q_fit_importance,
    "wide_profile": q_wide_profile,
    "interpolated_long": q_interpolated_long,
    "lag_features_long": q_lag_features_long,
    "source_asof": q_source_asof,
})
