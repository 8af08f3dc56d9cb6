"""Nulls, odd shapes, large counts and plans: one answer at every size."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import derive as D
from kindling.operators import evaluate as E
from kindling.operators import fit as FT
from kindling.operators import scoring as S
from kindling.sources.io import load_model, save_model


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(0, [1.0, -2.0]), (1, [None, 1.0]), (2, None), (3, [1.0]), (4, []), (5, [float("nan"), 1.0]), (6, [0.0, 3.0])]
    return spark.createDataFrame(rows, "key long, x array<double>").repartition(1)


def test_layers_give_null_for_incomplete_vectors(vectors):
    w = [[1.0, 0.0], [0.0, 1.0]]
    for n in (2, 40):  # few and many weights take one path
        wide = [r * n for r in w]
        got = {r.key: r.y for r in S.dense_layer(vectors, "x", wide, act="relu", out="y").collect()}
        assert got[0] == [1.0, 0.0] * n and got[6] == [0.0, 3.0] * n
        assert all(got[k] is None for k in (1, 2, 3, 4)) and math.isnan(got[5][0])
    got = {r.key: r.y for r in S.branch_concat(vectors, "x", [[[1.0]], [[1.0]]], [[0.0], [0.0]], w, out="y").collect()}
    assert got[0] == [2.0, -2.0] and got[1] is None and got[2] is None and got[3] is None
    for kernels in ([(1, 1, 1, 0.0)], [(1, 1, 1, 0.0)] * 9):
        got = {r.key: r.y for r in S.conv_features(vectors, "x", kernels, out="y").collect()}
        assert got[0] == [[-1.0, -1.0]] * len(kernels) and got[3] == [[1.0]] * len(kernels)
        assert got[4] == [[]] * len(kernels) and got[1] is None and got[2] is None
    assert S.dense_layer(vectors.limit(0), "x", w).collect() == []
    with pytest.raises(ValueError):
        S.dense_layer(vectors, "x", w, act="swish")


def test_batch_norm_takes_more_parameters_than_columns_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (float("nan"), None)], "`a.b` double, n double")
    params = spark.createDataFrame([(f"f{i}", 0.0, 1.0) for i in range(50)] + [("a.b", 2.0, 1.0), ("n", None, None)],
                                   "feature string, mean double, var double")
    rows = S.batch_norm(df, ["a.b", "n"], params, eps=0.0, scale={"a.b": 2.0}, shift={"a.b": 1.0}).collect()
    assert [r["a.b"] for r in rows] == [-1.0, 3.0, None] and {r.n for r in rows} == {None}
    assert [round(r["a.b"], 3) if r["a.b"] is not None else None for r in S.batch_norm(df, ["a.b"]).collect()] == [-1.0, 1.0, None]


def test_erf_and_activations():
    x = np.linspace(-7, 7, 4001)
    assert np.abs(S._erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12
    net = S.DenseNet([(np.array([[1.0]]), np.array([0.0]), "tanh"), (np.array([[2.0]]), np.array([0.0]), "identity")])
    assert net.logits(np.array([[3.0]]))[0] == pytest.approx(2 * math.tanh(3.0))


def test_auc_of_very_many_rows_is_exact(spark):
    for n in (3 * 10**9, 10**12):
        rows = [("m", 0.9, n, n // 3), ("m", 0.5, n // 7, n), ("m", 0.1, 5, n)]
        counts = spark.createDataFrame(rows, "model string, score double, pos bigint, neg bigint")
        fp, num = 0, 0
        total_n, total_p = sum(r[3] for r in rows), sum(r[2] for r in rows)
        for _, _, pos, neg in rows:
            fp += neg
            num += pos * (2 * (total_n - fp) + neg)
        expected = num / (2 * total_p * total_n)
        assert E.auc_from_counts(counts).first().auc == pytest.approx(expected, rel=1e-14)
        assert E.trapezoid_auc(None, counts=counts).first().trapezoid_auc == pytest.approx(expected, rel=1e-14)
        r = E.evaluation_from_counts(counts, find_best=True).first()
        assert r.auc == pytest.approx(expected, rel=1e-14) and r.tp + r.fn == total_p


def test_metrics_agree_on_rows_with_nulls_and_nan(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.2), ("m", 1, None), ("m", None, 0.3), ("m", 0, float("nan")), ("m", 1, 0.4)]
    scored = spark.createDataFrame(rows, "model string, label int, score double").withColumn("key", F.lit(1))
    loss = -(math.log(0.9) + math.log(0.8) + math.log(0.4)) / 3
    ev, ep = E.evaluation(scored).first(), E.epoch_metrics(scored).first()
    assert ev.n == ep.n == E.binary_metrics(scored).first().n == 3
    assert ev.loss == pytest.approx(loss) and ep.loss == pytest.approx(loss) and E.log_loss(scored).first().log_loss == pytest.approx(loss)
    assert ep.auc == ev.auc == 1.0
    w = E.evaluation(scored, pos_weight=2.0).first()
    assert w.loss == pytest.approx(-(2 * math.log(0.9) + math.log(0.8) + 2 * math.log(0.4)) / 3)


def test_evaluation_equals_the_cells_of_its_threshold(spark):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.5 else "b", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    scored = spark.createDataFrame(rows, "model string, label int, score double")
    best = E.evaluation(scored, find_best=True).cache()
    cells = {r.model: r for r in E.binary_metrics(scored, best.select("model", "threshold")).collect()}
    table = {r.model: r for r in E.evaluation(scored, best.select("model", "threshold")).collect()}
    for r in best.collect():
        for c in ("tn", "fp", "fn", "tp", "precision", "recall", "f1", "accuracy"):
            assert r[c] == cells[r.model][c] == table[r.model][c]


def test_no_full_counts_exchange_by_model_alone(spark):
    scored = spark.range(1000).select(F.lit("m").alias("model"), (F.col("id") % 2).cast("int").alias("label"),
                                      F.rand(3).alias("score"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.evaluation(scored, find_best=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(model#\d+, \d+\)", line):
            assert re.search("Aggregate|Project", lines[i + 1]), "only aggregated rows meet by model"
            assert "partial" in "".join(lines[i + 1:i + 4])


def test_every_model_scores_rows_with_null_features(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        y = i % 2
        rows.append((i, "train" if i < 80 else "valid", y, rng.gauss(2 * y - 1, 0.7) if i % 5 else None,
                     float("nan") if i % 7 == 0 else rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "key long, part string, label int, a double, b double")
    specs = {"logistic": FT.DEFAULT_SPECS["logistic"], "additive": lambda t, f, k, y: FT.fit_additive(t, f, y, n_bins=4),
             "mlp": lambda t, f, k, y: FT.fit_mlp(t, f, y, hidden=(4,), max_iter=30), "frozen_head": FT.DEFAULT_SPECS["frozen_head"]}
    evals, _ = FT.fit_and_evaluate(df, specs, ["a", "b"], "key")
    got = {r.model: r for r in evals.collect()}
    assert {r.n for r in got.values()} == {40} and all(r.auc > 0.6 for r in got.values())


def test_models_are_saved_and_loaded(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, i % 2, rng.gauss(i % 2, 1), rng.gauss(0, 1)) for i in range(60)],
                               "key long, label int, a double, b double")
    for name, model in {"lr": FT.fit_logistic(df, ["a", "b"]), "fh": FT.fit_frozen_head(df, ["a", "b"], "key")}.items():
        save_model(model, f"{tmp_path}/{name}")
        back = load_model(f"{tmp_path}/{name}")
        rows = lambda m: [r.score for r in FT.score(m, df, "key", "label", "m").orderBy("key").collect()]
        assert rows(back) == pytest.approx(rows(model))
        assert "Join" not in FT.score(back, df, "key", "label", "m")._jdf.queryExecution().executedPlan().toString()
    net = S.DenseNet.random([2, 3, 1], seed=1)
    save_model(net, f"{tmp_path}/net")
    x = np.array([[0.5, -1.0]])
    assert load_model(f"{tmp_path}/net").logits(x) == pytest.approx(net.logits(x))
    with pytest.raises(Exception):
        load_model(f"{tmp_path}/nothing")


def test_fitted_shape_tables_score_like_the_model(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, i % 2, rng.gauss(i % 2, 1), None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(200)],
                               "key long, label int, a double, b double")
    model = FT.fit_additive(df, ["a", "b"], n_bins=5)
    bins, shapes, bias = FT.additive_tables(model, ["a", "b"])
    ours = {r.key: r.additive_score for r in S.additive_scores(df, bins, shapes, bias).collect()}
    for r in FT.score(model, df, "key", "label", "m").collect():
        assert 1 / (1 + math.exp(-ours[r.key])) == pytest.approx(r.score, abs=1e-9)


def test_interpolation_of_one_long_place(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("p").alias("place"), F.col("id").alias("day"),
                               F.when(F.col("id") % 100 == 50, F.col("id") * 2.0).alias("v"))
    out = D.interpolate_linear(df, "place", "day", "v").orderBy("day").collect()
    assert out[0].v is None and out[60].v == pytest.approx(120.0) and out[-1].v == pytest.approx((n - 50) * 2.0)


def test_pivot_values_refuse_nulls_unless_told(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    with pytest.raises(ValueError):
        D.pivot_values(df, "c")
    assert D.pivot_values(df, "c", drop_null=True) == ["a", "b"]
