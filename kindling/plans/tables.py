"""Stand-ins on the driver tables: rows in the schemas the operators expect.

These only select and rename columns and apply the fixed formulas listed in
FIXTURES.md; none of them does an operator's work.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.sources.io import read_table

# Fixed values for the stand-ins (see FIXTURES.md).
EVENTS_CUT = dt.datetime(2024, 1, 25)
ORDERS_CUT = dt.datetime(2000, 1, 1)
EVENTS_DAY0 = dt.date(2024, 1, 1)
# Three fixed logistic "models" over events.value: (name, centre, scale).
SCORE_MODELS = (("m50_50", 50.0, 50.0), ("m40_30", 40.0, 30.0), ("m60_100", 60.0, 100.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, ts, user_id, label, value, hour)``; label = event_type is 'error'."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "user_id",
                     (F.col("event_type") == "error").cast("int").alias("label"),
                     "value", F.hour("ts").cast("double").alias("hour"))


def orders_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, o_orderdate, label, o_totalprice, priority, month)``; label = status 'F'."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderdate",
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    "o_totalprice",
                    F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
                    F.month("o_orderdate").cast("double").alias("month"))


def events_logits(spark: SparkSession, sf_dir: str, before: dt.datetime | None = None) -> DataFrame:
    """Logit table ``(key, model, label, logit)``: logit = (value - centre) / scale.

    ``before`` keeps only events earlier than that instant (a filter on the scan)."""
    ev = events_labelled(spark, sf_dir)
    if before is not None:
        from kindling.operators.prepare import instant

        ev = ev.filter(F.col("ts") < instant(before, ev.schema["ts"].dataType))
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(c).alias("c"), F.lit(s).alias("s"))
                                 for n, c, s in SCORE_MODELS]))
    return (ev.select("event_id", "label", "value", models.alias("m"))
            .select(F.col("event_id").alias("key"), F.col("m.model").alias("model"), "label",
                    ((F.col("value") - F.col("m.c")) / F.col("m.s")).alias("logit")))


def events_scored(spark: SparkSession, sf_dir: str, before: dt.datetime | None = None) -> DataFrame:
    """Scored table ``(key, model, label, score)``: score = round(sigmoid(logit), 4)."""
    lg = events_logits(spark, sf_dir, before)
    return lg.select("key", "model", "label",
                     F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))), 4).alias("score"))


def events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History table: run = user_id, one epoch per active day (0, 1, 2, … in day order).

    Metrics are daily statistics of event values: ``val_f1`` = mean / 100; the train
    metrics, ``val_loss`` and ``val_acc`` = mean of one event type / 100 (0 without
    such events); ``val_auc`` = min / 100, ``val_precision`` = max / 1000 and
    ``val_recall`` = (max - min) / 1000."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(EVENTS_DAY0))

    def m(t: str | None):
        v = F.col("value") if t is None else F.when(F.col("event_type") == t, F.col("value"))
        return F.coalesce(F.avg(v), F.lit(0.0)) / F.lit(100.0)

    daily = ev.groupBy(F.col("user_id").alias("run"), day.alias("day")).agg(
        m(None).alias("val_f1"), m("view").alias("train_loss"), m("click").alias("train_acc"),
        m("purchase").alias("train_auc"), m("signup").alias("val_loss"), m("error").alias("val_acc"),
        F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    w = Window.partitionBy("run").orderBy("day")
    return daily.select(
        "run", (F.row_number().over(w) - 1).alias("epoch"), "day",
        "train_loss", "train_acc", "train_auc", "val_loss", "val_acc",
        (F.col("_mn") / 100.0).alias("val_auc"), (F.col("_mx") / 1000.0).alias("val_precision"),
        ((F.col("_mx") - F.col("_mn")) / 1000.0).alias("val_recall"), "val_f1")


# Fixed stand-in values for the catalog queries on lineitem: its numeric columns and
# keyword groups over their names (two names fall in two groups, one in none).
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
LINEITEM_GROUPS = (("price", "price"), ("extended", "extended"), ("quantity", "quantity"),
                   ("discount", "discount"), ("count", "count"))


def lineitem_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem numeric columns plus ``label`` = returnflag is 'R'."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", *LINEITEM_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("label"))


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, day, value, n_events)``: daily mean value and event count per user."""
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(EVENTS_DAY0))
    return ev.groupBy("user_id", day.alias("day")).agg(F.avg("value").alias("value"),
                                                       F.count(F.lit(1)).alias("n_events"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, embedding array<float>, label)`` plus ``target`` = label >= 5 for binary jobs."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", (F.col("label") >= 5).cast("int").alias("target"))


# Fixed stand-in parameters for the scoring queries, all from simple integer formulas.
EMB_WIDTH = 64
ENTROPY_ALPHA = [((7 * j + 3) % 11 - 5) / 10 for j in range(EMB_WIDTH - 4)]
DENSE_W = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(4)] for i in range(EMB_WIDTH)]
DENSE_B = [(j - 1.5) / 10 for j in range(4)]
CONV_KERNELS = [(0.25, 0.5, 0.25, 0.0), (-1.0, 0.0, 1.0, 0.1)]
BRANCH_W = [[[((7 * i + 3 * j + b) % 11 - 5) / 10 for j in range(2)] for i in range(EMB_WIDTH // 4)] for b in range(4)]
BRANCH_B = [[0.05 * (b - j) for j in range(2)] for b in range(4)]
RESIDUAL_W = [[((5 * i + 2 * j) % 9 - 4) / 20 for j in range(8)] for i in range(EMB_WIDTH)]
ADDITIVE_BINS = {  # feature: (lo, width, n_bins)
    "l_quantity": (0.0, 10.0, 5),
    "l_extendedprice": (0.0, 20000.0, 5),
    "l_discount": (0.0, 0.02, 5),
    "l_tax": (0.0, 0.02, 5),
}
ADDITIVE_SHAPES = {f: [((5 * k + 3 * b) % 7 - 3) / 10 for b in range(n)]
                   for k, (f, (_, _, n)) in enumerate(ADDITIVE_BINS.items())}
ADDITIVE_BIAS = 0.1
CURVE_KNOTS = {f: [lo + width * b for b in range(n)] for f, (lo, width, n) in ADDITIVE_BINS.items()}


def formula_matrix(n: int, m: int, a: int, b: int, scale: float) -> list[list[float]]:
    """Weights ``((a·i + b·j) mod 11 - 5) / scale``, which SQL can state as well."""
    return [[((a * i + b * j) % 11 - 5) / scale for j in range(m)] for i in range(n)]


def network_layers() -> list:
    """A 64-8-4-1 network: relu, tanh, then the logit."""
    layers, acts = [], ("relu", "tanh", "identity")
    for k, (n, m) in enumerate([(EMB_WIDTH, 8), (8, 4), (4, 1)]):
        w = np.array(formula_matrix(n, m, 7 + k, 3 + k, 20.0))
        layers.append((w, np.array([(j - 1) / 10 for j in range(m)]), acts[k]))
    return layers


def frozen_weights(width: int = EMB_WIDTH, hidden: int = 16) -> dict:
    """Weights of a frozen block with a narrow hidden layer and an activation SQL can state."""
    f = lambda n, m, a, b: np.array(formula_matrix(n, m, a, b, 40.0))
    return {"wv": f(width, width, 7, 3), "bv": np.zeros(width), "wo": f(width, width, 5, 2), "bo": np.full(width, 0.1),
            "w1": f(width, hidden, 3, 4), "b1": np.zeros(hidden), "w2": f(hidden, width, 2, 9), "b2": np.zeros(width),
            "act": "gelu_tanh"}
