import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.operators import evaluate as E
from kindling.operators.prefix import running_sums_desc


def scored_df(spark, rows, model="m"):
    return spark.createDataFrame([(i, model, y, s) for i, (y, s) in enumerate(rows)],
                                 "key long, model string, label int, score double")


# --- brute-force references (plain numpy, the curve conventions written out) -----------------

def np_curve(y, s):
    y, s = np.asarray(y), np.asarray(s)
    thr = np.unique(s)[::-1]
    tps = np.array([(y[s >= t] == 1).sum() for t in thr])
    fps = np.array([(y[s >= t] == 0).sum() for t in thr])
    return thr, tps, fps


def np_pr(y, s):
    thr, tps, fps = np_curve(y, s)
    prec = tps / (tps + fps)
    rec = tps / tps[-1] if tps[-1] else np.ones_like(tps, dtype=float)
    return thr, prec, rec


def np_best_threshold(y, s):
    thr, prec, rec = np_pr(y, s)
    f1 = 2 * (prec * rec) / (prec + rec + 1e-8)
    order = np.lexsort((thr, -f1))  # highest f1, then lowest threshold
    return thr[order[0]]


def np_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    tot = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos)
    return tot / (len(pos) * len(neg))


def np_roc_reduced(y, s):
    thr, tps, fps = np_curve(y, s)
    if len(fps) > 2:
        keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
        thr, tps, fps = thr[keep], tps[keep], fps[keep]
    return sorted(float(t) for t in thr)


def random_rows(n, seed, decimals=2):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.4), round(rng.random(), decimals)) for _ in range(n)]


# --- hand-made cases -----------------------------------------------------------------------------

def test_threshold_tie_predicts_zero(spark):
    df = scored_df(spark, [(1, 0.5), (0, 0.7)])
    got = {r.key: r.pred for r in E.with_prediction(df, 0.5).collect()}
    assert got == {0: 0, 1: 1}


def test_score_ties_auc_half(spark):
    assert E.auc(scored_df(spark, [(0, 0.5), (1, 0.5)])).collect()[0].auc == 0.5


def test_single_class_auc_null(spark):
    assert E.auc(scored_df(spark, [(1, 0.2), (1, 0.9)])).collect()[0].auc is None


def test_no_predicted_positive(spark):
    r = E.binary_metrics(scored_df(spark, [(1, 0.2), (0, 0.4), (1, 0.5)]), 0.5).collect()[0]
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_empty_confusion_cells(spark):
    rows = E.confusion_matrix(scored_df(spark, [(1, 0.9), (0, 0.1), (1, 0.8)]), 0.5).collect()
    cells = {(r.label, r.pred): r.n for r in rows}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_log_loss_floor(spark):
    r = E.log_loss(scored_df(spark, [(1, 0.0), (0, 0.0)])).collect()[0]
    assert r.log_loss == pytest.approx(50.0)


def test_weighted_log_loss(spark):
    df = spark.createDataFrame([("m", 1, 0.3), ("m", 0, -1.2)], "model string, label int, logit double")
    got = E.weighted_log_loss(df, pos_weight=2.0).collect()[0].weighted_log_loss
    want = (2.0 * math.log(1 + math.exp(-0.3)) + math.log(1 + math.exp(-1.2))) / 2
    assert got == pytest.approx(want, rel=1e-12)


# --- against brute force ---------------------------------------------------------------------------

@pytest.mark.parametrize("n_buckets,partitions", [(1, 1), (7, 4), (1 << 16, 17)])
def test_running_sums_equal_one_task_window(spark, n_buckets, partitions):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), round(rng.random(), 3), rng.randint(0, 5)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, c long").groupBy("g", "x").agg(F.sum("c").alias("c"))
    df = df.repartition(partitions)
    got = {(r.g, r.x): r.cum_c for r in running_sums_desc(df, ["g"], "x", ["c"], n_buckets=n_buckets).collect()}
    w = Window.partitionBy("g").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.x): r.s for r in df.withColumn("s", F.sum("c").over(w)).collect()}
    assert got == want


def test_curves_and_metrics_match_brute_force(spark):
    rows = random_rows(800, seed=5)
    y = [r[0] for r in rows]
    s = [r[1] for r in rows]
    df = scored_df(spark, rows).repartition(5)
    assert E.auc(df).collect()[0].auc == pytest.approx(np_auc(y, s), abs=1e-12)
    assert E.trapezoid_auc(df).collect()[0].trapezoid_auc == pytest.approx(np_auc(y, s), abs=1e-12)
    thr, prec, rec = np_pr(y, s)
    pr = {r.threshold: (r.precision, r.recall) for r in E.pr_curve(df).collect()}
    assert pr.pop(None) == (1.0, 0.0)
    assert len(pr) == len(thr)
    for t, p, r in zip(thr, prec, rec):
        assert pr[float(t)] == pytest.approx((p, r), abs=1e-12)
    mp = E.mean_precision(df).collect()[0].mean_precision
    assert mp == pytest.approx((prec.sum() + 1) / (len(prec) + 1), abs=1e-12)
    assert E.best_threshold(df).collect()[0].threshold == pytest.approx(np_best_threshold(y, s))
    red = sorted(r.threshold for r in E.roc_curve(df, drop_intermediate=True).collect() if r.threshold != math.inf)
    assert red == np_roc_reduced(y, s)


def test_auc_unchanged_under_second_sigmoid(spark):
    rows = random_rows(300, seed=9, decimals=6)
    df = scored_df(spark, rows)
    twice = df.withColumn("score", 1 / (1 + F.exp(-F.col("score"))))
    assert E.auc(df).collect()[0].auc == pytest.approx(E.auc(twice).collect()[0].auc, abs=1e-12)


def test_evaluation_many_models_one_job(spark):
    a = scored_df(spark, random_rows(300, 1), "a")
    b = scored_df(spark, random_rows(200, 2), "b")
    ev = {r.model: r for r in E.evaluation(a.unionByName(b), find_best=True).collect()}
    assert set(ev) == {"a", "b"}
    for r in ev.values():
        assert r.tp + r.fp + r.fn + r.tn == r.n
        assert r.accuracy == pytest.approx((r.tp + r.tn) / r.n)


def test_metric_bars_and_display(spark):
    ev = E.evaluation(scored_df(spark, random_rows(100, 3)), 0.5)
    comp = E.model_comparison(ev)
    assert E.metric_bars(comp).count() == 5
    disp = E.comparison_display(comp.fillna({"training_time": 1234.56789, "parameters": 37725825})).collect()[0]
    assert disp.training_time == "1,234.5679" and disp.parameters == "37,725,825"


def test_range_buckets_exact_on_skewed_scores(spark):
    from kindling.operators.prefix import range_buckets
    from kindling.session import cut_lineage

    rng = random.Random(4)
    # nearly all distinct scores inside one 1e-6-wide range, a few spread out
    rows = [("m", 0.5 + rng.random() * 1e-6, rng.randint(0, 3)) for _ in range(1500)]
    rows += [("m", rng.random(), 1) for _ in range(50)] + [("n", rng.random(), 2) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, c long").groupBy("g", "x").agg(F.sum("c").alias("c"))
    tagged = cut_lineage(range_buckets(df, ["g"], "x", n=16))
    sizes = [r["count"] for r in tagged.groupBy("_bk").count().collect()]
    assert max(sizes) < 0.2 * sum(sizes)  # no hot bucket despite the skew
    got = {(r.g, r.x): r.cum_c for r in running_sums_desc(tagged, ["g"], "x", ["c"], bucket_col="_bk").collect()}
    w = Window.partitionBy("g").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.x): r.s for r in df.withColumn("s", F.sum("c").over(w)).collect()}
    assert got == want


def test_io_sinks_and_model_roundtrip(spark, tmp_path):
    from kindling.operators import fit as FT
    from kindling.sources import io

    ev = E.evaluation(scored_df(spark, random_rows(100, 8)), 0.5)
    comp = E.comparison_display(E.model_comparison(ev))
    io.write_csv(comp, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == comp.columns and back.count() == 1
    io.write_report(ev, str(tmp_path / "report"), run_id="r1")
    io.write_report(ev, str(tmp_path / "report"), run_id="r2")
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    data = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(40)], "key long, a double, label int")
    model = FT.fit_logistic(data, ["a"])
    io.save_model(model, str(tmp_path / "model"))
    again = io.load_model(str(tmp_path / "model"))
    s1 = [r.score for r in FT.score(model, data, "key", "label", "x").orderBy("key").collect()]
    s2 = [r.score for r in FT.score(again, data, "key", "label", "x").orderBy("key").collect()]
    assert s1 == s2


def test_first_max_per_group_ties_to_smallest(spark):
    df = spark.createDataFrame([("a", 0.3, 0.9), ("a", 0.1, 0.9), ("a", 0.2, 0.5), ("b", 0.7, 0.1)],
                               "model string, threshold double, f1 double")
    got = {r.model: r.threshold for r in E.first_max_per_group(df, "model", "f1", "threshold").collect()}
    assert got == {"a": 0.1, "b": 0.7}


def test_top_n(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.9), ("z", 0.5), ("w", None)], "feature string, v double")
    assert [r.feature for r in E.top_n(df, "v", 3, tie="feature").collect()] == ["y", "x", "z"]


def test_next_row_across_buckets(spark):
    from kindling.operators.prefix import running_sums_desc

    rng = random.Random(12)
    rows = [(rng.choice("ab"), round(rng.random(), 3), rng.randint(0, 4)) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, x double, c long").groupBy("g", "x").agg(F.sum("c").alias("c"))
    for nb in (1, 5, 64):
        got = {(r.g, r.x): r.next_c for r in running_sums_desc(df, ["g"], "x", ["c"], n_buckets=nb,
                                                                 next_cols=["c"]).collect()}
        w = Window.partitionBy("g").orderBy(F.col("x").desc())
        want = {(r.g, r.x): r.n for r in df.withColumn("n", F.lead("c").over(w)).collect()}
        assert got == want
