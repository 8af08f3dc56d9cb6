"""Epoch-wise fits against a plain loop, permutation importance and moments against numpy, and the rules for NaN and labels."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kindling.operators import catalog as C
from kindling.operators import evaluate as E
from kindling.operators import fit as FT
from kindling.operators import history as H
from kindling.operators import moments as M
from kindling.operators.epochs import evaluate_parts, final_evaluation, fit_epochs, history_table, with_vector
from kindling.operators.importance import permutation_importance
from kindling.operators.moments import moments
from kindling.operators.prepare import fit_scaler
from kindling.operators.scoring import Bins, Edges, additive_scores

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        y = int(a - 0.7 * b + rng.gauss(0, 0.8) > 0)
        rows.append((i, "train" if i < 400 else "valid", y, a if i % 50 else None, b if i % 60 else float("nan"), c))
    rows += [(900, "valid", None, 1.0, 1.0, 1.0), (901, None, 1, 1.0, 1.0, 1.0), (902, "train", 3, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "key long, part string, label int, a double, b double, c double").repartition(3).cache()


def sklearn_free_metrics(y, s, t):
    """Loss, accuracy, AUC, precision, recall and F1 by their definitions."""
    pred = s > t
    tp, fp, fn = (pred & (y == 1)).sum(), (pred & (y == 0)).sum(), (~pred & (y == 1)).sum()
    loss = -np.mean(np.where(y == 1, 2 * np.log(s), np.log(1 - s)))
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    return loss, (pred == (y == 1)).mean(), auc, tp / max(tp + fp, 1), tp / max(tp + fn, 1), 2 * tp / max(2 * tp + fp + fn, 1)


def plain_search(y, s):
    best = None
    for t in sorted(set(s.tolist())):
        p, r = (y[s >= t] == 1).mean(), (y[s >= t] == 1).sum() / (y == 1).sum()
        f1 = 2 * p * r / (p + r + 1e-8)
        if best is None or f1 > best[0] + 1e-15:
            best = (f1, t)
    return best[1]


def test_epoch_fit_equals_a_plain_loop(spark, prepared, tmp_path):
    n_epochs, patience, iterations = 6, 2, 3
    folder = str(tmp_path / "runs")
    fitted = fit_epochs(prepared, FEATURES, folder, run="r", hidden=(4,), n_epochs=n_epochs, patience=patience, iterations=iterations)
    # the same, driven by hand
    rows = with_vector(prepared.where("label in (0, 1) and part is not null"), FEATURES)
    train = FT.repeat_positives(rows.where("part = 'train'"), "label", 2)
    model, threshold, best, best_f1, since, history = None, 0.5, None, 0.0, 0, []
    for epoch in range(n_epochs):
        solver = MultilayerPerceptronClassifier(featuresCol="_fv", layers=[3, 4, 2], maxIter=iterations, seed=42)
        model = (solver if model is None else solver.setInitialWeights(model.weights)).fit(train)
        got = model.transform(rows).select("part", "label", vector_to_array("probability")[1].alias("s")).toPandas()
        y, s, valid = got.label.to_numpy(), got.s.to_numpy(), (got.part == "valid").to_numpy()
        if epoch % 2 == 0 or epoch == n_epochs - 1:
            threshold = plain_search(y[valid], s[valid])
        v, t = sklearn_free_metrics(y[valid], s[valid], threshold), sklearn_free_metrics(y[~valid], s[~valid], 0.5)
        history.append((epoch, *t[:3], *v, threshold))
        since += 1
        if v[5] > best_f1:
            best, best_f1, since = epoch, v[5], 0
        if since >= patience:
            break
    table = history_table(spark, folder)
    stored = [tuple(r)[1:-1] for r in table.collect()]
    assert len(stored) == len(history) and np.allclose(stored, history, atol=1e-5)
    assert (fitted.epoch, pytest.approx(fitted.threshold, abs=1e-6)) == (best, threshold)
    decision = H.early_stop(table, patience=patience).first()
    assert decision.best_epoch == best and decision.epochs_run == len(history)
    # curves read the table; the returned model is the saved one of the best epoch
    assert H.training_curves(table).count() == 10 * len(history)
    record = final_evaluation(fitted, prepared.where("part = 'valid'"), "m").first()
    if threshold == history[best][-1]:
        assert record.f1 == pytest.approx(best_f1, abs=1e-5)
    # a finished run is only read again
    again = fit_epochs(prepared, FEATURES, folder, run="r", hidden=(4,), n_epochs=len(history), patience=patience, iterations=iterations)
    assert again.epoch == best and (again.model.weights.toArray() == fitted.model.weights.toArray()).all()
    assert history_table(spark, folder).count() == len(history)


def test_an_ended_run_is_continued(spark, prepared, tmp_path):
    whole, parts = str(tmp_path / "a"), str(tmp_path / "b")
    fit_epochs(prepared, FEATURES, whole, n_epochs=5, patience=9, iterations=2)
    fit_epochs(prepared, FEATURES, parts, n_epochs=3, patience=9, iterations=2)  # its epoch 2 searches in both
    fit_epochs(prepared, FEATURES, parts, n_epochs=5, patience=9, iterations=2)
    a, b = ([tuple(r)[1:] for r in history_table(spark, f).collect()] for f in (whole, parts))
    assert len(a) == 5 and np.allclose([r[:-1] for r in a], [r[:-1] for r in b], atol=1e-9)


def test_one_part_only_has_no_metrics_of_the_other(spark, prepared, tmp_path):
    fitted = fit_epochs(prepared.where("part = 'train'"), FEATURES, str(tmp_path / "x"), n_epochs=2, iterations=1)
    rows = history_table(spark, str(tmp_path / "x")).collect()
    assert fitted.epoch == 1 and [r.val_f1 for r in rows] == [None, None] and rows[0].train_auc is not None
    rows = with_vector(prepared.where("part = 'valid' and label is not null"), FEATURES)
    assert set(evaluate_parts(fitted.model, rows, None, 1.0)) == {"valid"}


def test_dealt_rows_give_the_same_fit(prepared, monkeypatch):
    train = prepared.where("part = 'train' and label in (0, 1)").coalesce(1).cache()
    fits = []
    for cost in (1e18, 1.0):
        monkeypatch.setattr(FT, "TASK_COST", cost)
        assert FT.spread_rows(train, 10, 10).rdd.getNumPartitions() == (1 if cost > 1 else train.sparkSession.sparkContext.defaultParallelism)
        fits.append(FT.fit_logistic(train, FEATURES).stages[-1])
    assert np.allclose(fits[0].coefficients.toArray(), fits[1].coefficients.toArray(), atol=1e-6)


def test_all_models_are_evaluated_together(prepared):
    specs = {"one": FT.DEFAULT_SPECS["logistic"], "two": lambda tr, f, k, y: FT.fit_logistic(tr, f[:1], y)}
    usable = prepared.where("label in (0, 1)")
    evals, comparison = FT.fit_and_evaluate(usable, specs, FEATURES, "key")
    single = {n: FT.fit_and_evaluate(usable, {n: s}, FEATURES, "key")[0].first() for n, s in specs.items()}
    rows = {r.model: r for r in evals.collect()}
    assert rows.keys() == single.keys() and comparison.count() == 2
    for n, alone in single.items():
        assert all(a == b or a == pytest.approx(b, rel=1e-12) for a, b in zip(rows[n], alone))


def test_permutation_importance_equals_numpy(spark):
    rng = random.Random(9)
    rows = [(f"k{i}", int(rng.random() < 0.5), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    rows = [(k, y, a + y, b - y, c) for k, y, a, b, c in rows] + [("null label", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + [(None, 1, 0.0, 0.0, 0.0)], "key string, label int, a double, b double, c double").repartition(4)
    out = permutation_importance(df, lambda d: d.withColumn("score", F.col("a") - 2 * F.col("b")), FEATURES, "key", seed=7).collect()
    order = lambda salt: np.argsort([hashlib.md5(f"{salt}:7:{r[0]}".encode()).hexdigest() for r in rows])
    giver = np.empty(len(rows), int)
    giver[order("take")] = order("give")
    x, y = np.array([r[2:] for r in rows]), np.array([-1 if r[1] is None else r[1] for r in rows])

    def auc(v):
        s = v[:, 0] - 2 * v[:, 1]
        pos, neg = s[y == 1], s[y == 0]
        return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))

    expected = {}
    for j, f in enumerate(FEATURES):
        changed = x.copy()
        changed[:, j] = x[giver, j]
        expected[f] = auc(x) - auc(changed)
    assert {r.feature: pytest.approx(r.importance, abs=1e-12) for r in out} == expected
    assert [r.feature for r in out] == sorted(FEATURES, key=lambda f: (-expected[f], f)) and expected["c"] == 0 < expected["b"]
    one = permutation_importance(df.where("label = 1"), lambda d: d.withColumn("score", F.col("a")), FEATURES, "key").collect()
    assert [(r.feature, r.importance) for r in one] == [(f, None) for f in FEATURES]


def test_moments_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, names = 400, [f"x`{i}" for i in range(6)]
    x = rng.normal(1e6, 1, size=(n, 6))
    x[:, 3], x[:, 4] = 0.1, np.nan  # constant; without values
    x[rng.random((n, 6)) < 0.2] = np.nan
    y = rng.integers(0, 2, n).astype(float)
    rows = [(*[None if i % 3 == 0 and math.isnan(v) else float(v) for v in r], None if i % 17 == 0 else float(y[i])) for i, r in enumerate(x)]
    y[::17] = np.nan
    df = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` double" for c in names) + ", y double")
    for parts in (1, 9):
        got = {r.feature: r for r in moments(df.repartition(parts), names, "y").collect()}
        for j, f in enumerate(names):
            v, both = x[~np.isnan(x[:, j]), j], ~np.isnan(x[:, j]) & ~np.isnan(y)
            r = got[f]
            assert (r["rows"], r.n, r.n_xy) == (n, len(v), both.sum())
            if len(v):
                assert r.mean == pytest.approx(v.mean(), rel=1e-12) and r.m2 == pytest.approx(len(v) * v.var(), rel=1e-9, abs=1e-18)
                assert (r.min, r.max) == (v.min(), v.max())
                assert r.c_xy == pytest.approx(((x[both, j] - x[both, j].mean()) * (y[both] - y[both].mean())).sum(), rel=1e-6, abs=1e-9)
            else:
                assert (r.mean, r.min, r.m2) == (None, None, 0.0)
        assert got[names[3]].m2 == 0.0
        std = {r.feature: r.std for r in fit_scaler(df.repartition(parts), names).collect()}
        assert std[names[3]] == std[names[4]] == 1.0
    zero = moments(df.limit(0), names, "y").collect()
    assert [r.n for r in zero] == [0] * 6 and {r.mean for r in zero} == {None}
    monkeypatch.setattr(M, "LARGE", -1)  # partial rows merged in two steps
    assert [r.n for r in moments(df.repartition(9), names, "y").collect()] == [got[f].n for f in names]
    plan = moments(df, names, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "stack" not in plan and "Expand" not in plan


def test_wide_profile_equals_the_long_one(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 2 else 2.0, float("nan")) for i in range(50)],
                               "key int, temp_a double, ndvi_b double, c double")
    names = ["temp_a", "ndvi_b", "c"]
    cat = C.feature_group_catalog(C.names_frame(spark, names))
    long, wide = (sorted(map(repr, d.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes]).collect()))
                  for d in (C.group_profile(C.to_long(df, ["key"], names), cat), C.group_profile_wide(df, names, cat)))
    assert long == wide and len(long) == 3


def test_a_nan_value_ranks_no_feature_first(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2), float("nan") if i == 3 else float(i), None, 5.0) for i in range(20)],
                               "label int, good double, holed double, none double, flat double")
    rows = C.feature_rank(df, ["holed", "none", "good", "flat"], "label").collect()
    assert [r.feature for r in rows] == ["good", "holed", "flat", "none"] and rows[0].importance == pytest.approx(1.0)
    assert 0 < rows[1].importance < 1 and rows[2].importance is None is rows[3].importance
    values = spark.createDataFrame([("a", float("nan")), ("b", 1.0), ("c", None), ("d", 2.0)], "f string, v double")
    assert [r.f for r in E.top_n(values, "v", 4, tie="f").collect()] == ["d", "b", "a", "c"]


def test_a_nan_metric_improves_nothing(spark):
    h = spark.createDataFrame([("r", 0, 0.2, 0.5), ("r", 1, float("nan"), float("nan")), ("r", 2, 0.4, 0.7), ("r", 3, None, 0.8)],
                              "run string, epoch int, val_f1 double, threshold double")
    r = H.early_stop(h).first()
    assert (r.best_epoch, r.best_metric, r.epochs_run) == (2, 0.4, 4)
    h = spark.createDataFrame([("r", 0, 0.3), ("r", 1, 0.4), ("r", 2, float("nan")), ("r", 3, 0.6)], "run string, epoch int, s double")
    assert [x.threshold for x in H.threshold_schedule(h, "s").orderBy("epoch").collect()] == [0.3, 0.3, 0.3, 0.6]


def test_one_label_rule_in_all_losses(spark):
    df = spark.createDataFrame([("m", 1, 0.8), ("m", 0, 0.3), ("m", 2, 0.4), ("m", None, 0.5)], "model string, label int, score double")
    whole = E.evaluation(df).first()
    assert E.log_loss(df).first().log_loss == pytest.approx(whole.loss) and whole.n == 3
    expected = -(math.log(0.8) + math.log(0.7) + math.log(0.6)) / 3
    assert whole.loss == pytest.approx(expected)
    logits = df.withColumn("logit", F.log(F.col("score") / (1 - F.col("score"))))
    assert E.weighted_log_loss(logits, 1.0).first().weighted_log_loss == pytest.approx(expected)
    odd = spark.createDataFrame([("m", float("nan"), 0.8), ("m", 1.0, 0.6)], "model string, label double, score double")
    assert E.evaluation(odd).first().n == E.binary_metrics(odd).first().n == 1


def test_a_missing_value_is_zero_for_every_kind_of_bins(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (0.0,)], "x double")
    bins, edges = Bins(-1.0, 1.0, 2), Edges((0.0,))
    for b in (bins, edges):
        got = [r.additive_score for r in additive_scores(df, {"x": b}, {"x": [1.0, 2.0]}).collect()]
        assert got == [2.0, 2.0, 2.0, 2.0]


def test_weights_are_saved_as_blocks(spark, tmp_path, monkeypatch):
    import time

    from kindling.operators.scoring import DenseNet
    from kindling.sources import io

    rng = np.random.default_rng(0)
    path = str(tmp_path / "net")
    start = time.time()
    net = DenseNet([(rng.normal(size=(4000, 1000)), rng.normal(size=1000), "relu"), (rng.normal(size=(1000, 1)), np.zeros(1), "sigmoid")])
    io.save_model(net, path)
    back = io.load_model(path)
    assert time.time() - start < 60  # four million weights, none of them a Python object
    for (w, b, act), (w2, b2, act2) in zip(net.layers, back.layers):
        assert act == act2 and np.array_equal(w, w2) and np.array_equal(b, b2)
    monkeypatch.setattr(io, "TILE_BYTES", 24)
    small = DenseNet([(rng.normal(size=(5, 2)), rng.normal(size=2), "tanh")])
    io.save_model(small, path)  # replaces the model; the old tiles are gone
    assert np.array_equal(io.load_model(path).layers[0][0], small.layers[0][0])
    assert sum(p.name.startswith("weights-") for p in (tmp_path / "net").iterdir()) == 1
