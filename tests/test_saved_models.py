"""Models that tasks open from shared storage."""

import random

import numpy as np
import pytest

from kindling.operators import fit as FT
from kindling.operators import scoring as S
from kindling.sources import weights as W
from kindling.sources.io import load_model, save_model, saved_model


def vectors(spark, n=200, width=6):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)] if i % 17 else None) for i in range(n)]
    return spark.createDataFrame(rows, "key long, x array<double>").repartition(5)


def test_saved_network_scores_like_the_network(spark, tmp_path):
    net = S.DenseNet.random([6, 8, 1], seed=2)
    save_model(net, f"{tmp_path}/net")
    saved = saved_model(f"{tmp_path}/net")
    assert (saved.kind, saved.width, saved.nbytes) == ("DenseNet", 6, 8 * net.n_values())
    df = vectors(spark)
    rows = lambda m: [r.score for r in S.batch_score(df, "x", m, "key").orderBy("key").collect()]
    assert rows(saved) == rows(net) and rows(saved)[0] is None
    assert rows(load_model(f"{tmp_path}/net", in_tasks=True)) == rows(net)
    assert S.batch_score(df.limit(0), "x", saved, "key").count() == 0


def test_saved_block_and_head(spark, tmp_path):
    block = S.FrozenBlock.random(6, seed=5)
    save_model(block, f"{tmp_path}/block")
    df = vectors(spark)
    rows = lambda b: [r.frozen for r in S.frozen_block_features(df, "x", b, "key").orderBy("key").collect()]
    assert rows(saved_model(f"{tmp_path}/block")) == rows(block) == rows(load_model(f"{tmp_path}/block"))
    rng = random.Random(1)
    table = spark.createDataFrame([(i, i % 2, rng.gauss(i % 2, 1), rng.gauss(0, 1)) for i in range(60)],
                                  "key long, label int, a double, b double")
    head = FT.fit_frozen_head(table, ["a", "b"], "key")
    save_model(head, f"{tmp_path}/head")
    there = load_model(f"{tmp_path}/head", in_tasks=True)
    score = lambda m: [r.score for r in FT.score(m, table, "key", "label", "m").orderBy("key").collect()]
    assert isinstance(there.block, W.SavedModel) and score(there) == score(head)
    save_model(there, f"{tmp_path}/copy")
    assert score(load_model(f"{tmp_path}/copy")) == score(head)


def test_a_worker_reads_a_model_once_and_keeps_a_bounded_amount(spark, tmp_path, monkeypatch):
    for k in range(3):
        save_model(S.DenseNet.random([4, 4, 1], seed=k), f"{tmp_path}/{k}")
    read = []
    real = W.read_parts
    monkeypatch.setattr(W, "read_parts", lambda uri, shapes: read.append(uri) or real(uri, shapes))
    monkeypatch.setattr(W, "_OPEN", type(W._OPEN)())
    limit = 2 * 8 * 25  # two models of 4 * 4 + 4 + 4 + 1 values
    a, b, c = (saved_model(f"{tmp_path}/{k}", max_bytes=limit) for k in range(3))
    x = np.ones((1, 4))
    for m in (a, a, b, a, b):
        m.value.logits(x)
    assert read == [a.uri, b.uri]
    c.value  # the one used longest ago, a, goes
    b.value
    assert read == [a.uri, b.uri, c.uri] and list(W._OPEN) == [c.uri, b.uri]


def test_refusals(spark, tmp_path):
    save_model(S.DenseNet.random([4, 4, 1]), f"{tmp_path}/net")
    with pytest.raises(ValueError, match="at most"):
        saved_model(f"{tmp_path}/net", max_bytes=100)
    with pytest.raises(FileNotFoundError):
        saved_model(f"{tmp_path}/nothing")
    uri = saved_model(f"{tmp_path}/net").uri
    with pytest.raises(OSError, match="lack"):
        W.read_parts(uri, {"0.w": [4, 4], "0.b": [4], "1.w": [4, 2], "1.b": [1]})


def test_large_weights_are_read_in_tiles(spark, tmp_path):
    big = S.DenseNet([(np.arange(1200 * 1500, dtype=float).reshape(1200, 1500), np.zeros(1500), "identity"),
                      (np.ones((1500, 1)), np.zeros(1), "identity")])  # 14.4 MB: four tiles
    save_model(big, f"{tmp_path}/big")
    back = saved_model(f"{tmp_path}/big").value
    assert np.array_equal(back.layers[0][0], big.layers[0][0])


def test_addresses_of_file_systems():
    where, path = W.filesystem("file:/a/b c")
    assert path == "/a/b c" and where.type_name == "local"
    assert W.filesystem("file:///a/b")[1] == "/a/b"
