import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kindling.operators import fit as FT
from kindling.operators import network as N


def _rows(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.5 * rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, label int")


def _plain(weights, layers, x, y, w):
    """Weighted mean loss in plain double precision."""
    z, views = x, N.layer_views(weights, layers)
    for k, (m, b) in enumerate(views):
        z = z @ m + b
        z = 1 / (1 + np.exp(-z)) if k + 1 < len(views) else z
    return float(w @ (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]) / w.sum())


@pytest.mark.parametrize("layers", [[2, 2], [2, 3, 2], [2, 6, 5, 4, 2]])
def test_gradient_sums_are_the_slope_of_the_loss(layers):
    rng = np.random.default_rng(0)
    size = sum((a + 1) * b for a, b in zip(layers[:-1], layers[1:]))
    weights, x, y = rng.normal(size=size), rng.normal(size=(700, 2)), rng.integers(0, 2, 700)  # some blocks, one short
    w = rng.choice([1.0, 2.0], 700)
    got = N.GradientSum(weights, layers)
    got.add(x[:400], y[:400], w[:400])
    got.add(x[400:], y[400:], w[400:])
    assert got.weight == w.sum() and got.loss / got.weight == pytest.approx(_plain(weights, layers, x, y, w), abs=1e-7)
    for i in range(size):
        d = np.zeros(size)
        d[i] = 1e-5
        slope = (_plain(weights + d, layers, x, y, w) - _plain(weights - d, layers, x, y, w)) / 2e-5
        assert got.gradient[i] / got.weight == pytest.approx(slope, abs=1e-6)


def test_network_fits_as_sparks_class_on_repeated_rows(spark):
    rows = _rows(spark).coalesce(1)
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="_fv").transform(FT.repeat_positives(rows, "label", 2))
    theirs = MultilayerPerceptronClassifier(featuresCol="_fv", labelCol="label", layers=[2, 5, 3, 2], maxIter=8, seed=42,
                                            blockSize=plain.count()).fit(plain.coalesce(1))
    ours = FT.fit_mlp(rows, ["a", "b"], hidden=(5, 3), max_iter=8).stages[-1]
    assert ours.getLayers() == [2, 5, 3, 2] and FT.parameter_count(ours) == 15 + 18 + 8
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), atol=1e-3)


def test_a_pass_hands_the_driver_few_gradients(spark, monkeypatch):
    rows = _rows(spark).select("a", "b", F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"))
    weights = np.linspace(-1, 1, 8 * 3 + 2 * 9)
    one = N.mean_loss(rows.coalesce(1), [2, 8, 2])(weights)
    monkeypatch.setattr(N, "FEW_SUMS", 4)
    many = N.mean_loss(rows.repartition(23), [2, 8, 2])(weights)  # more parts than FEW_SUMS: groups of partitions
    assert many[0] == pytest.approx(one[0], rel=1e-12) and np.allclose(many[1], one[1], rtol=1e-6, atol=1e-9)


def test_no_rows_and_wrong_labels_are_errors(spark):
    rows = _rows(spark)
    with pytest.raises(ValueError, match="training rows"):
        FT.fit_mlp(rows.where("label = 7"), ["a", "b"], hidden=(3,), max_iter=2)
    with pytest.raises(Exception, match="labels of a network"):
        FT.fit_mlp(rows.withColumn("label", F.col("label") + 1), ["a", "b"], hidden=(3,), max_iter=2)


def test_dealing_fills_whole_rounds_of_cores(spark, monkeypatch):
    monkeypatch.setattr(FT, "TASK_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    dealt = FT.spread_rows(spark.range(10 * cores + 1), 1 << 40, 1)
    assert dealt.rdd.getNumPartitions() == 2 * cores


@pytest.mark.parametrize("layers", [[2, 2], [2, 3, 2], [2, 6, 5, 2]])
def test_sums_do_not_depend_on_the_blocks(layers, monkeypatch):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=sum((a + 1) * b for a, b in zip(layers[:-1], layers[1:])))
    x, y, w = rng.normal(size=(130, 2)), rng.integers(0, 2, 130), rng.choice([1.0, 2.0], 130)
    one = N.GradientSum(weights, layers)
    one.add(x, y, w)
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)  # four blocks and a short one
    many = N.GradientSum(weights, layers)
    many.add(x, y, w)
    assert many.weight == one.weight and many.loss == pytest.approx(one.loss, rel=1e-6)
    assert np.allclose(many.gradient, one.gradient, rtol=1e-4, atol=1e-5)


def test_passes_read_packed_rows(spark, monkeypatch):
    """a pass over 5,000 rows hands the tasks a few packed ones, cut by bytes, with every row in them."""
    rows = _rows(spark, 5000).select("a", "b", F.col("label").cast("double").alias("y"), F.lit(2.0).alias("w")).coalesce(2)
    packed = N.packed_rows(rows, [2, 4, 2])
    got = packed.collect()
    assert len(got) <= 4 and packed.rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, 2) for r in got])
    y = np.concatenate([np.frombuffer(r.y, np.int64) for r in got])
    assert [(a, b, int(t), 2.0) for a, b, t, _ in rows.collect()] == [(a, b, t, w) for (a, b), t, w in zip(
        x.tolist(), y.tolist(), np.concatenate([np.frombuffer(r.w) for r in got]).tolist())]
    monkeypatch.setattr(N, "PACK_BYTES", 16 * 100)
    cut = N.packed_rows(rows, [2, 4, 2])
    sizes = [len(r.w) // 8 for r in cut.collect()]
    assert max(sizes) == 100 and sum(sizes) == 5000
    weights = np.linspace(-1, 1, 12 + 10)
    assert N.packed_loss(cut, [2, 4, 2])(weights)[0] == pytest.approx(N.packed_loss(packed, [2, 4, 2])(weights)[0], rel=1e-6)
