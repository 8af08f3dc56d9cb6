import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions.columns import hash_order
from kindling.operators import prepare as P


def test_boundary_date(spark):
    cut = dt.datetime(2022, 1, 1)
    df = spark.createDataFrame([(1, cut), (2, cut - dt.timedelta(seconds=1)), (3, None)], "k long, ts timestamp_ntz")
    got = {r.k: r.part for r in P.time_split(df, "ts", cut).collect()}
    assert got == {1: "valid", 2: "train"}


def test_split_part_filter_reaches_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    plan = P.split_part(df, "l_shipdate", dt.datetime(1997, 1, 1), P.TRAIN).select("l_orderkey")._jdf \
        .queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("cap,k", [(None, 3), (2, 2), (9, 3), (0, 3)])
def test_rows_per_class_cap(spark, cap, k):
    rows = [(i, "train", 0) for i in range(5)] + [(10 + i, "train", 1) for i in range(3)]
    df = spark.createDataFrame(rows, "key long, part string, label int")
    got = P.rows_per_class(P.class_counts(df, "label"), "label", cap=cap).collect()[0]
    assert got.k == k
    sample = P.balanced_sample(df, "key", "label", cap=cap).groupBy("label").count().collect()
    assert sorted((r.label, r["count"]) for r in sample) == [(0, k), (1, k)]


def test_missing_class_is_an_error(spark):
    df = spark.createDataFrame([(1, "train", 0), (2, "train", 0)], "key long, part string, label int")
    with pytest.raises(Exception, match="a class is missing"):
        P.balanced_sample(df, "key", "label").collect()


def _reference_sample(df, k_by_part):
    w = Window.partitionBy("part", "label").orderBy(hash_order("key", "42:"), "key")
    ranked = df.withColumn("rn", F.row_number().over(w))
    keep = F.lit(False)
    for part, k in k_by_part.items():
        keep = keep | ((F.col("part") == part) & (F.col("rn") <= k))
    return {r.key for r in ranked.filter(keep).collect()}


@pytest.mark.parametrize("digits,partitions", [(1, 1), (2, 4), (4, 17)])
def test_balanced_sample_equals_global_ranking(spark, digits, partitions):
    rng = random.Random(7)
    rows = [(i, "train" if rng.random() < 0.6 else "valid", 1 if rng.random() < 0.3 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, part string, label int").repartition(partitions)
    counts = {}
    for part in ("train", "valid"):
        c = [sum(1 for r in rows if r[1] == part and r[2] == y) for y in (0, 1)]
        counts[part] = min(c)
    got = {r.key for r in P.balanced_sample(df, "key", "label", digits=digits).collect()}
    assert got == _reference_sample(df, counts)
    assert len(got) == 2 * sum(counts.values())


def test_shuffle_uses_a_different_salt(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "key long")
    out = P.shuffle_order(df, "key").withColumn("h", hash_order("key", "42:")).collect()
    assert [r.key for r in out] != [r.key for r in sorted(out, key=lambda r: r.h)]
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    params = P.collect_params(P.fit_scaler(df, ["x", "c"]))
    assert params["x"][1] == pytest.approx(1.2472191, abs=1e-6)
    assert params["c"] == (5.0, 1.0)
    out = P.scaler_transform(df, params, ["x", "c"]).collect()
    assert [r.c for r in out] == [0.0, 0.0, 0.0]
    xs = [r.x for r in out]
    assert sum(xs) == pytest.approx(0.0, abs=1e-12)


def test_scaler_equals_a_wide_aggregate(spark):
    rng = random.Random(3)
    cols = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(rng.gauss(0, 1) for _ in cols) for _ in range(200)], ", ".join(f"{c} double" for c in cols))
    got = P.collect_params(P.fit_scaler(df, cols))
    from pyspark.sql import functions as F

    for c in cols:
        assert got[c] == pytest.approx(tuple(df.agg(F.avg(c), F.stddev_pop(c)).first()), rel=1e-12)


def test_scaler_dotted_names_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "`a.b` double, n double")
    got = {r.feature: (r["mean"], r["std"]) for r in P.fit_scaler(df, ["a.b", "n"]).collect()}
    assert got == {"a.b": (2.0, 1.0), "n": (None, 1.0)}
    assert {r.feature for r in P.fit_scaler(df.limit(0), ["a.b", "n"]).collect()} == {"a.b", "n"}


def test_balanced_sample_takes_some_rows_of_a_key_that_repeats(spark):
    rows = [("a", "p", 1, 0.0)] * 6 + [("a", "p", 1, float(i)) for i in range(4)] + [(f"z{i}", "p", 0, 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "key string, part string, label int, x double").repartition(3)
    for cap, k in ((None, 7), (3, 3), (1, 1)):
        out = P.balanced_sample(df, "key", "label", cap=cap)
        got = sorted(map(tuple, out.collect()))
        assert [sum(r[2] == y for r in got) for y in (0, 1)] == [k, k] and out.columns == df.columns
        again = P.balanced_sample(df.repartition(5), "key", "label", cap=cap).collect()
        assert got == sorted(map(tuple, again))  # whatever the layout
        assert all(got.count(r) <= rows.count(r) for r in got)
    many = [("hot", "p", i % 2, float(i % 5)) for i in range(400)] + [(f"k{i}", "p", i % 2, 0.0) for i in range(50)]
    df = spark.createDataFrame(many, "key string, part string, label int, x double")
    for cap in (1, 20, 100, 224, None):
        got = [r.label for r in P.balanced_sample(df, "key", "label", cap=cap, digits=1).collect()]
        assert (got.count(0), got.count(1)) == (min(cap or 225, 225),) * 2



def test_prepare_balanced_and_scaled(spark):
    from kindling.plans import tables as T

    ev = T.events_labelled(spark, "/root/testdata/sf0.001")
    prepared, params = P.prepare(ev, "event_id", "label", "ts", T.EVENTS_CUT, ["value", "hour"])
    counts = {(r.part, r.label): r["count"] for r in prepared.groupBy("part", "label").count().collect()}
    assert counts[("train", 0)] == counts[("train", 1)]
    assert counts[("valid", 0)] == counts[("valid", 1)]
    stats = prepared.filter("part = 'train'").agg(F.avg("value"), F.stddev_pop("value")).collect()[0]
    assert stats[0] == pytest.approx(0.0, abs=1e-9)
    assert stats[1] == pytest.approx(1.0, abs=1e-9)
    assert "ts" not in prepared.columns


def test_cut_is_wall_clock_in_any_session_time_zone(spark):
    cut = dt.datetime(2022, 1, 1)
    df = spark.createDataFrame([(1, cut), (2, cut - dt.timedelta(seconds=1))], "k long, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = {r.k: r.part for r in P.time_split(df, "ts", cut).collect()}
        only = [r.k for r in P.split_part(df, "ts", cut, P.TRAIN).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {1: "valid", 2: "train"} and only == [2]


def test_assemble_float_vector(spark):
    df = spark.createDataFrame([(1.5, 2, None)], "a double, b int, c double")
    out = P.assemble(df, ["a", "b", "c"], "v")
    assert out.schema["v"].dataType.simpleString() == "array<float>"
    assert out.collect()[0].v == [1.5, 2.0, None]


def test_null_keys_are_not_sampled(spark):
    rows = [(None, "train", 0)] * 3 + [(i, "train", 0) for i in range(4)] + [(10 + i, "train", 1) for i in range(2)]
    df = spark.createDataFrame(rows, "key long, part string, label int")
    got = P.balanced_sample(df, "key", "label").collect()
    assert all(r.key is not None for r in got)
    assert sorted((r.label, 1) for r in got) == [(0, 1), (0, 1), (1, 1), (1, 1)]


def test_scratch_tables_are_dropped(spark):
    import os

    from kindling.session import cut_lineage, drop_scratch_tables, scratch_root

    t = cut_lineage(spark.range(10))
    assert t.count() == 10
    root = scratch_root(spark)
    local = root[len("file:"):] if root.startswith("file:") else root
    assert os.path.isdir(local) and os.listdir(local)
    assert drop_scratch_tables(spark)
    assert not os.path.exists(local)
