"""Continuous shape functions (N6, T3): hat vectors, the smoothed fit, scoring and storage."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from kindling.operators import curves as CV
from kindling.operators import evaluate as E
from kindling.operators import fit as FT
from kindling.operators.scoring import _weight_bytes
from kindling.sources.io import load_model, save_model


def bumps(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.uniform(-2, 2), rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-(3 - 3 * a * a))))  # high in the middle: no straight line fits
        rows.append((i, y, a, None if i % 11 == 0 else float("nan") if i % 13 == 0 else b, 7.0))
    return spark.createDataFrame(rows, "key long, label int, a double, b double, c double")


def test_curve_scores_are_linear_between_knots_and_flat_outside(spark):
    df = spark.createDataFrame([(0, -5.0, 1.0), (1, 0.5, None), (2, 1.5, float("nan")), (3, 9.0, 2.0), (4, None, 3.0)],
                               "curve_score int, a double, `b.c` double")
    curves = CV.Curves(["a", "b.c"], [np.array([0.0, 1.0, 2.0]), np.array([1.0])], [np.array([0.0, 2.0, -2.0]), np.array([0.25])], 0.5)
    got = [r.curve_score for r in CV.curve_scores(df, curves, "curve_score").collect()]
    assert got == pytest.approx([0.75, 1.75, 0.75, -1.25, 0.75])  # a name that is there is replaced
    assert CV.curve_scores(df.limit(0), curves).count() == 0
    with pytest.raises(ValueError):
        CV.curve_scores(df, CV.Curves(["a"], [np.array([1.0, 1.0])], [np.array([0.0, 0.0])], 0.0))


def test_hat_vectors_sum_to_one_per_feature(spark):
    df = bumps(spark, 80)
    knots = CV.quantile_knots(df, ["a", "b", "c"], 6)
    assert [len(k) for k in knots] == [6, 6, 1] and all((np.diff(k) > 0).all() for k in knots)
    rows = CV.hat_vectors(df, ["a", "b", "c"], knots).orderBy("key").collect()
    for r in rows:
        v = r._fv.toArray()
        assert len(v) == 14 and v[-1] == 1.0 and (v >= 0).all()
        assert v[:6].sum() == pytest.approx(1) and v[6:12].sum() == pytest.approx(1) and v[12] == 1.0
        assert v[:6] @ knots[0] == pytest.approx(r.a)  # hats reproduce the value between the outer knots


def test_scores_equal_the_fitted_logit(spark):
    df = bumps(spark)
    feats = ["a", "b", "c"]
    knots = CV.quantile_knots(df, feats, 8)
    lr = CV.fit_hats(df, feats, knots)
    curves = CV.curves_of(lr, feats, knots)
    hats = CV.hat_vectors(df, feats, knots)
    want = {r.key: r.z for r in lr.transform(hats).select("key", vector_to_array("rawPrediction")[1].alias("z")).collect()}
    for r in CV.curve_scores(df, curves).collect():
        assert r.curve_score == pytest.approx(want[r.key], abs=1e-9)
    assert all(np.interp(0.0, k, w) == pytest.approx(0.0, abs=1e-12) for k, w in zip(curves.knots, curves.shapes))


def test_a_curve_fits_what_a_line_cannot(spark):
    df = bumps(spark)
    auc = lambda m: E.auc(FT.score(m, df, "key", "label", "m")).first().auc
    curves = CV.fit_curves(df, ["a", "b", "c"])
    assert auc(curves) > 0.85 > 0.65 > auc(FT.fit_logistic(df, ["a", "b", "c"]))
    assert FT.parameter_count(curves) == sum(map(len, curves.knots)) + 1
    straight = CV.fit_curves(df, ["a"], smooth=1e4)
    slopes = np.diff(straight.shapes[0]) / np.diff(straight.knots[0])
    assert np.ptp(slopes) < 0.05  # a heavy penalty leaves straight lines


def test_fit_equals_a_direct_minimisation(spark):
    """Newton steps on the same loss with the exact penalty loss in numpy."""
    df = bumps(spark, 300)
    knots = CV.quantile_knots(df, ["a"], 6)
    x = np.array([r._fv.toArray() for r in CV.hat_vectors(df, ["a"], knots).orderBy("key").collect()])
    y = np.array([r.label for r in df.orderBy("key").collect()], float)
    w = np.where(y == 1, 2.0, 1.0)
    smooth = 0.01
    extra = np.array([v.toArray() for v in CV.bend_rows(knots) for _ in (0, 1)])
    x2, y2 = np.vstack([x, extra]), np.concatenate([y, np.tile([0.0, 1.0], len(extra) // 2)])
    w2 = np.concatenate([w, np.full(len(extra), 4 * smooth * w.sum() / CV.BEND_SCALE ** 2)])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x2 @ beta))
        hess = (x2 * (w2 * p * (1 - p))[:, None]).T @ x2 + 1e-9 * np.eye(len(beta))
        beta -= np.linalg.solve(hess, x2.T @ (w2 * (p - y2)))
    got = CV.fit_hats(df, ["a"], knots, smooth=smooth).coefficients.toArray()
    assert x @ got == pytest.approx(x @ beta, abs=5e-3)


def test_curves_are_saved_loaded_and_listed(spark, tmp_path):
    df = bumps(spark, 200)
    curves = CV.fit_curves(df, ["a", "b"], n_knots=5)
    save_model(curves, f"{tmp_path}/m")
    back = load_model(f"{tmp_path}/m")
    rows = lambda m: [r.score for r in FT.score(m, df, "key", "label", "m").orderBy("key").collect()]
    assert rows(back) == rows(curves)
    table = CV.curve_table(spark, curves).collect()
    assert len(table) == 10 and _weight_bytes(curves) == 160
    plan = FT.score(curves, df, "key", "label", "m")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_constant_features_and_one_class_of_knots(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), 3.0) for i in range(40)], "key long, label int, c double")
    got = CV.fit_curves(df, ["c"], pos_weight=1.0)
    p = {r.score for r in FT.score(got, df, "key", "label", "m").collect()}
    assert len(p) == 1 and p.pop() == pytest.approx(0.25, abs=1e-3)  # the bias alone gives the share of positives
    with pytest.raises(ValueError):
        CV.quantile_knots(df, ["c"], 1)
