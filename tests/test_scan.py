"""Two-level scans against the plain windows, on long places, ties, nulls and empty tables."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.operators import scan
from kindling.operators.derive import interpolate_linear, lag_features, merge_asof


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(6)
    rows = [("long", t, rng.choice([None, float("nan"), rng.random(), rng.random()])) for t in range(3000)]
    rows += [(f"p{k}", t, rng.choice([None, float(t)])) for k in range(40) for t in range(rng.randint(0, 9))]
    rows += [(None, t, None if t % 3 else float(t)) for t in range(50)] + [("none", t, None) for t in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "place string, t int, x double")


def same(a, b):
    a, b = ([tuple(repr(v) for v in r) for r in d.collect()] for d in (a, b))
    assert sorted(a) == sorted(b) and len(a) > 0


@pytest.mark.parametrize("n", [1, 7, 40])
def test_carried_values_equal_the_window(series, n):
    known = F.when(F.col("x") > 0.5, F.col("x"))
    up = Window.partitionBy("place").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("place").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    plain = series.withColumns({"p": F.last(known, True).over(up), "n": F.last(known, True).over(down)})
    d = scan.ranges(series, ["place"], ["t"], n)
    d = scan.carry(scan.carry(d, ["place"], ["t"], {"p": known}), ["place"], ["t"], {"n": known}, forward=False)
    assert d.where("place = 'long'").select(scan.RANGE).distinct().count() >= min(n, 7)  # a long place spans ranges
    same(d.drop(scan.RANGE).select(plain.columns), plain)


@pytest.mark.parametrize("n", [1, 9, 600])
def test_shifted_rows_equal_lag(series, n):
    w = Window.partitionBy("place").orderBy("t")
    plain = series.withColumns({f"{c}_lag_{s}": F.lag(c, s).over(w) for c in ("x", "t") for s in (1, 2, 7)})
    d = scan.shift(scan.ranges(series, ["place"], ["t"], n), ["place"], ["t"], ["x", "t"], [1, 2, 7]).drop(scan.RANGE)
    same(d.select(plain.columns), plain)


def test_long_places_give_the_same_columns(series):
    for f in (lambda **k: interpolate_linear(series, "place", "t", "x", out="y", **k),
              lambda **k: lag_features(series, "place", "t", ["x"], [1, 5], **k)):
        same(f(long_places=True), f())


def test_a_nan_is_a_missing_value(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, None), ("a", 4, 4.0), ("a", 5, float("nan"))],
                               "place string, t int, x double")
    for long_places in (False, True):
        got = interpolate_linear(df, "place", "t", "x", long_places=long_places).orderBy("t").collect()
        assert [r.x for r in got] == [1.0, 2.0, 3.0, 4.0, 4.0]


def test_one_place_of_a_million_rows_is_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("only").alias("place"), F.col("id").alias("t"),
                               F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("x"))
    d = scan.ranges(df, ["place"], ["t"], 16)
    sizes = [r["count"] for r in d.groupBy(scan.RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * n / 16
    got = scan.carry(d, ["place"], ["t"], {"p": F.col("x")}).agg(
        F.sum((F.col("p") != F.floor(F.col("t") / 1000) * 1000).cast("int")).alias("wrong"), F.count("p").alias("n")).first()
    assert (got.wrong, got.n) == (0, n)


def test_row_index_is_the_place_in_hash_order(spark):
    import hashlib

    df = spark.range(500).withColumn("key", F.concat(F.lit("k"), "id"))
    for n in (1, 5, 64):
        got = {r["key"]: r["index"] for r in scan.row_index(df, "key", "s:", n).collect()}
        expected = sorted(got, key=lambda k: (hashlib.md5(f"s:{k}".encode()).hexdigest(), k))
        assert [got[k] for k in expected] == list(range(500))


def brute_asof(base, source, max_age):
    out = []
    for i, (place, t) in enumerate(base):
        best = None
        for p, s, v in source:
            if p is not None and p == place and s is not None and t is not None and s <= t and (max_age is None or t - s <= max_age):
                best = max(best or (s, -1), (s, v))
        out.append((i, *(best or (None, None))))
    return sorted(out)


@pytest.mark.parametrize("max_age", [None, 3])
def test_asof_merge_equals_brute_force(spark, max_age):
    rng = random.Random(3)
    base = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for _ in range(300)] + [("a", 5)] * 3
    one = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 60, 7)]), rng.randint(0, 9)) for _ in range(80)]
    two = [(rng.choice(["a", "c"]), rng.randint(0, 60), rng.randint(0, 9)) for _ in range(10)]
    day = lambda d: d.withColumn("t", F.timestamp_seconds(F.col("t") * 86400))
    b = day(spark.createDataFrame([(i, *r) for i, r in enumerate(base)], "i int, place string, t int"))
    tables = [day(spark.createDataFrame(x, "place string, t int, v int")) for x in (one, two)]
    out = merge_asof(b, ("one", tables[0], ["v"]), ("two", tables[1], ["v"]), place="place", time="t",
                     max_age=None if max_age is None else f"{max_age} days")
    assert out.columns == ["i", "place", "t", "one_t", "one_v", "two_t", "two_v"]
    days = lambda c: (F.unix_seconds(c) / 86400).cast("int")
    for name, source in (("one", one), ("two", two)):
        got = sorted(tuple(r) for r in out.select("i", days(f"{name}_t"), f"{name}_v").collect())
        assert repr(got) == repr(brute_asof(base, source, max_age))
    assert merge_asof(b.limit(0), ("one", tables[0], ["v"]), place="place", time="t").collect() == []
    assert merge_asof(b, ("one", tables[0].limit(0), ["v"]), place="place", time="t").where("one_t is not null").count() == 0
    with pytest.raises(ValueError, match="already"):
        merge_asof(b.withColumn("one_v", F.lit(1)), ("one", tables[0], ["v"]), place="place", time="t")
