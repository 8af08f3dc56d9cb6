import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.functions import arrays as A
from kindling.operators import prepare as P
from kindling.operators import scoring as S


def test_entropy_equal_shares(spark):
    df = spark.createDataFrame([([0.3, 0.3, 0.3, 0.3],)], "x array<double>")
    got = S.entropy_scores(df, "x", n_landcover=4).collect()[0].entropy_score
    assert got == pytest.approx(math.log(4), abs=1e-9)


def test_entropy_width_below_landcover(spark):
    df = spark.createDataFrame([([1.0, 1.0],)], "x array<double>")
    assert S.entropy_scores(df, "x", n_landcover=4).collect()[0].entropy_score == pytest.approx(math.log(2), abs=1e-9)


def test_convolution_case(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(A.conv1d_same("x", (1, 1, 1)).alias("y")).collect()[0].y == [3.0, 6.0, 5.0]


def test_batch_norm_equals_scaler_without_eps(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    bn = [r.x for r in S.batch_norm(df, ["x"], eps=0.0).collect()]
    sc = [r.x for r in P.scaler_transform(df, P.fit_scaler(df, ["x"]), ["x"]).collect()]
    assert bn == pytest.approx(sc, abs=1e-12)


def test_layer_norm_row(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    got = S.layer_norm(df, "x", eps=0.0).collect()[0].x
    x = np.array([1.0, 2.0, 4.0])
    assert got == pytest.approx(list((x - x.mean()) / x.std()), abs=1e-12)


def test_dense_array_form_equals_long_form(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(5, 3)).round(3).tolist()
    b = [0.1, -0.2, 0.3]
    rows = [(k, rng.normal(size=5).round(3).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "key long, x array<double>")
    arr = {r.key: r.hidden for r in S.dense_layer(df, "x", w, b, act="relu").collect()}
    long = df.select("key", F.posexplode("x").alias("i", "x"))
    wt = spark.createDataFrame([(i, j, w[i][j]) for i in range(5) for j in range(3)], "i int, j int, w double")
    bt = spark.createDataFrame([(j, b[j]) for j in range(3)], "j int, b double")
    for r in S.dense_layer_long(long, wt, bt, act="relu").collect():
        assert arr[r.key][r.j] == pytest.approx(r.h, abs=1e-12)


def test_additive_wide_equals_long(spark):
    bins = {"a": S.Bins(0.0, 1.0, 3), "b": S.Bins(-1.0, 0.5, 4)}
    shapes = {"a": [0.1, 0.2, 0.3], "b": [-0.1, 0.0, 0.1, 0.2]}
    rows = [(k, float(k % 5) - 1.0, (k % 7) / 3.0 - 1.0) for k in range(30)]
    df = spark.createDataFrame(rows, "key long, a double, b double")
    wide = {r.key: r.additive_score for r in S.additive_scores(df, bins, shapes, 0.5).collect()}
    shape_t = spark.createDataFrame([(f, i, v) for f, vs in shapes.items() for i, v in enumerate(vs)],
                                    "feature string, bin int, w double")
    long = df.unpivot("key", ["a", "b"], "feature", "value")
    for r in S.additive_scores_long(long, bins, shape_t, "key", 0.5).collect():
        assert wide[r.key] == pytest.approx(r.additive_score, abs=1e-12)


def test_frozen_block_matches_numpy(spark):
    block = S.FrozenBlock.random(4, seed=1)
    x = np.array([[0.1, -0.2, 0.3, 0.4], [1.0, 0.0, -1.0, 0.5]])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "key long, x array<float>")
    got = {r.key: r.frozen for r in S.frozen_block_features(df, "x", block, key="key").collect()}
    want = block.forward(x.astype(np.float32).astype(np.float64))
    for i in range(2):
        assert got[i] == pytest.approx(list(want[i]), abs=1e-5)


def test_batch_score_network(spark):
    net = S.DenseNet.random([3, 4, 1], seed=2)
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 1)], "key long, x array<float>, y int")
    r = S.batch_score(df, "x", net, key="key", model_name="n", label="y").collect()[0]
    z = net.logits(np.array([[0.1, 0.2, 0.3]], dtype=np.float32).astype(np.float64))[0]
    assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r.model == "n"


def test_feature_slices_sizes(spark):
    df = spark.createDataFrame([(list(range(10)),)], "x array<int>")
    four = df.select(*[s.alias(f"s{i}") for i, s in enumerate(A.feature_slices("x", 4))]).collect()[0]
    assert [len(four[i]) for i in range(4)] == [2, 2, 2, 4]
    three = df.select(*[s.alias(f"s{i}") for i, s in enumerate(A.feature_slices("x", 3))]).collect()[0]
    assert [len(three[i]) for i in range(3)] == [3, 3, 4]


def test_wide_dense_numpy_path_equals_sql_form(spark):
    rng = np.random.default_rng(5)
    w = rng.normal(size=(40, 30)).tolist()  # 1200 weights: above the SQL bound
    b = rng.normal(size=30).tolist()
    df = spark.createDataFrame([(k, rng.normal(size=40).tolist()) for k in range(25)], "key long, x array<double>")
    got = {r.key: r.hidden for r in S.dense_layer(df, "x", w, b, act="selu").collect()}
    want = {r.key: r.h for r in df.select("key", A.dense("x", w, b, "selu").alias("h")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_wide_branch_concat_numpy_path_equals_sql_form(spark):
    rng = np.random.default_rng(6)
    rows_per_slice = [10, 10, 10, 12]  # width 42 in four slices: 10, 10, 10 and the rest
    bw = [rng.normal(size=(n, 8)).tolist() for n in rows_per_slice]
    bb = [rng.normal(size=8).tolist() for _ in range(4)]
    rw = rng.normal(size=(42, 32)).tolist()  # 1664 weights in total: above the SQL bound
    df = spark.createDataFrame([(k, rng.normal(size=42).tolist()) for k in range(10)], "key long, x array<double>")
    got = {r.key: r.branches for r in S.branch_concat(df, "x", bw, bb, rw).collect()}
    sl = A.feature_slices("x", 4)
    cat = F.concat(*[A.dense(s_, w, b_, "relu") for s_, w, b_ in zip(sl, bw, bb)])
    want_df = df.select("key", A.residual_add(cat, A.dense("x", rw, None, "identity")).alias("v"))
    want = {r.key: r.v for r in want_df.collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_many_filter_conv_numpy_path_equals_sql_form(spark):
    rng = np.random.default_rng(7)
    kernels = [tuple(rng.normal(size=4)) for _ in range(6)]  # above the SQL filter bound
    df = spark.createDataFrame([(k, rng.normal(size=9).tolist()) for k in range(12)], "key long, x array<double>")
    got = {r.key: r.conv for r in S.conv_features(df, "x", kernels, act="relu").collect()}
    want = {r.key: r.c for r in df.select("key", A.conv1d_filters("x", kernels, "relu").alias("c")).collect()}
    for k in want:
        for g, w in zip(got[k], want[k]):
            assert g == pytest.approx(w, abs=1e-12)


def test_a_model_beyond_the_limit_is_not_broadcast(spark, monkeypatch):
    import numpy as np
    import pytest

    from kindling.operators import scoring as S

    net = S.DenseNet([(np.ones((3, 2)), np.zeros(2), "relu"), (np.ones((2, 1)), np.zeros(1), "sigmoid")])
    assert S._weight_bytes(net) == 8 * (6 + 2 + 2 + 1)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, x array<double>")
    monkeypatch.setattr(S, "MODEL_BYTES", 8 * 11)
    assert S.dense_layer(df, "x", np.ones((3, 2)).tolist(), [0.0, 0.0], "relu").count() == 1
    monkeypatch.setattr(S, "MODEL_BYTES", 8)
    with pytest.raises(ValueError, match="MODEL_BYTES"):
        S.dense_layer(df, "x", np.ones((3, 2)).tolist(), [0.0, 0.0], "relu")
