"""Hard negatives against a brute-force search with Python's integers."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.llm import negatives as N
from kindling.llm.negatives import hard_negatives
from kindling.llm.queries import QUERIES
from tests_paths import SF001


def brute(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    """``rows``: (id, label, vector, is anchor). Equal (id, label, vector) give equal answers, so their order is free."""
    whole = [(i, y, [math.floor(scale * float(x)) for x in v], a) for i, y, v, a in rows
             if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for k, (i, y, v, a) in enumerate(whole):
        if not a:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, z) for m, (j, z, w, _) in enumerate(whole) if m != k]
        scored.sort(key=lambda t: order(t[0], t[1]))
        for s, j, _ in [t for t in scored if t[2] == y][:positives]:
            found = [t for t in scored if t[2] != y and low * s <= 100 * t[0] <= high * s][:negatives]
            out += [(i, j, r + 1, t[1], s, t[0]) for r, t in enumerate(found)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, is_anchor boolean")
    return df.withColumns({"row": F.lit(1), "norm": F.lit("x"), "g": F.lit(None), "scores": F.lit(2)})


@pytest.fixture(scope="module")
def cloud():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(600):
        c = rng.randrange(4)
        rows.append((i, rng.choice([c, c, rng.randrange(5)]), [x + rng.gauss(0, 0.4) for x in centres[c]], i % 10 == 0))
    rows += [(1000 + k, 1, [0.5] * 8, k % 7 == 0) for k in range(80)]  # one vector many times
    rows += [(1100 + k, 2, [0.25] * 8, False) for k in range(80)]
    rows += [(2000, None, [1.0] * 8, True), (2001, 1, None, True), (2002, 1, [1.0, None] + [0.0] * 6, True),
             (2003, 1, [float("nan")] * 8, True), (2004, 1, [float("inf")] * 8, False), (2005, 3, [0.0] * 8, True),
             (2006, 3, [0.0] * 8, False), (2007, 9, [1.0] * 8, True), (None, 1, [0.6] * 8, False), (None, 2, [0.3] * 8, None),
             (2008, 1, [2.0, -1.0], True), (2009, 2, [], True), (5, 3, [0.1] * 8, False)]
    return rows + [(2010, 1, [0.7] * 8, True)] * 2 + [(2011, 2, [0.45] * 8, False)] * 3


@pytest.mark.parametrize("block, together, directions", [(8192, 128, 12), (50, 3, 2)])
def test_equal_to_brute_force(spark, cloud, block, together, directions, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "TOGETHER", together)
    monkeypatch.setattr(N, "REFERENCES", directions)
    out = hard_negatives(frame(spark, cloud).repartition(5), F.col("is_anchor"))
    expected = brute(cloud)
    assert rows_of(out) == expected and len(expected) > 300
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_other_parameters_and_empty_tables(spark, cloud):
    out = hard_negatives(frame(spark, cloud), F.col("is_anchor"), positives=2, negatives=4, low_percent=-20, high_percent=130)
    assert rows_of(out) == brute(cloud, positives=2, negatives=4, low=-20, high=130)
    assert hard_negatives(frame(spark, cloud).limit(0), F.col("is_anchor")).collect() == []
    assert hard_negatives(frame(spark, cloud), F.lit(False)).collect() == []
    assert hard_negatives(frame(spark, [(1, 1, None, True)]), F.lit(True)).collect() == []


def test_large_components_are_scored_exactly(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 6, 7]) for _ in range(4)], i % 3 == 0) for i in range(60)]
    assert rows_of(hard_negatives(frame(spark, rows), F.col("is_anchor"))) == brute(rows)


def test_bounds_never_leave_out_a_score():
    """Slices of random windows, thin ones around the true score included, always hold the row."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, d = int(rng.integers(2, 60)), int(rng.integers(1, 6))
        v = np.floor(256 * rng.normal(size=(n, d)) * rng.choice([0, 0.01, 1, 30], size=(n, 1)))
        a = np.concatenate([np.floor(256 * rng.normal(size=(5, d))), v[:3], -v[:3]])
        directions = N.pick_directions(v, 4)
        unit, norm = N._unit(v)
        ua, na = N._unit(a)

        class Block:
            angles = np.arccos(np.clip(unit @ directions.T, -1, 1))
        cell = Block.angles.argmin(axis=1)
        order = np.lexsort((Block.angles[np.arange(n), cell], cell))
        Block.angles, Block.norm, cell, v = Block.angles[order], norm[order], cell[order], v[order]
        s = a @ v.T
        x = np.arccos(np.clip(ua @ directions.T, -1, 1))
        for c in np.unique(cell):
            i, j = np.flatnonzero(cell == c)[[0, -1]] + [0, 1]
            for k in range(i, j):
                for low, high in ((s[:, k], s[:, k]), (s[:, k] - 5, np.full(len(a), np.inf)), (np.full(len(a), -np.inf), s[:, k])):
                    first, last = N.run_slices(Block, (int(c), int(i), int(j)), x, na, low.astype(float), high.astype(float))
                    assert ((first <= k) & (k < last)).all()


def test_bounds_filter_what_lies_far_apart():
    rng = np.random.default_rng(2)
    v = np.floor(256 * (np.array([[1.0, 0, 0]]) + 0.05 * rng.normal(size=(500, 3))))
    unit, norm = N._unit(v)

    class Block:
        angles = np.sort(np.arccos(unit @ np.array([[1.0, 0, 0]]).T), axis=0)
    Block.norm = norm
    far, at = np.array([[np.pi / 2]]), np.array([300.0])  # an anchor at a right angle to the direction
    first, last = N.run_slices(Block, (0, 0, 500), far, at, np.array([0.9 * 256 * 300]), np.array([np.inf]))
    assert first[0] == last[0]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding, r.vec_id % 50 == 0) for r in rows]
    assert rows_of(QUERIES["op13_hard_negatives"](spark, SF001)) == brute(rows)
