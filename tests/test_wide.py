"""Plan-shape checks on a 276-column table built from spark.range by a fixed formula."""

import pytest
from pyspark.sql import functions as F

from kindling.operators import catalog as C
from kindling.operators import prepare as P

N_FEATURES = 276
KEYWORDS = ["ndvi", "moisture", "temp", "precip", "wind", "pop"]


def feature_names():
    names = []
    for i in range(N_FEATURES):
        kw = KEYWORDS[i % len(KEYWORDS)]
        names.append(f"{kw}_{i}" if i % 3 else f"{kw}_{i}_lag_{i % 7}")
    return names


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    cols = [F.sin(F.col("id") * F.lit(i + 1)).cast("float").alias(n) for i, n in enumerate(feature_names())]
    day = F.date_add(F.lit("2021-06-01").cast("date"), (F.col("id") % 400).cast("int"))
    path = str(tmp_path_factory.mktemp("wide") / "wide.parquet")
    spark.range(2000).select(
        "id", *cols, (F.col("id") % 3 == 0).cast("float").alias("is_fire"), day.cast("timestamp_ntz").alias("acq_date")
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_scaler_reads_wide_tables_without_a_long_form(wide):
    params = P.fit_scaler(wide, feature_names())
    plan = params._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "stack(" not in plan and plan.count("Scan parquet") == 1  # a row of vectors per task
    assert params.count() == N_FEATURES


def test_prepare_wide_table(wide):
    prepared, params = P.prepare(wide.withColumn("label", F.col("is_fire").cast("int")).drop("is_fire"),
                                 "id", "label", "acq_date", "2022-01-01", feature_names())
    assert len(params) == N_FEATURES
    counts = {(r.part, r.label): r["count"] for r in prepared.groupBy("part", "label").count().collect()}
    assert counts[("train", 0)] == counts[("train", 1)] and counts[("valid", 0)] == counts[("valid", 1)]


def test_catalogs_on_wide_names(spark, wide):
    names = C.names_frame(spark, wide.columns)
    groups = {r.group: r["count"] for r in C.feature_group_catalog(names, exclude=("is_fire", "acq_date", "id"))
              .groupBy("group").count().collect()}
    assert groups["vegetation"] == N_FEATURES // 6 and groups["other"] == N_FEATURES // 6
    lags = C.lag_catalog(names)
    by_lag = {r.lag: r["count"] for r in lags.groupBy("lag").count().collect()}
    # lag-0-parsed names are dropped; id is a plain name; is_fire and acq_date are excluded
    assert by_lag[0] == sum(1 for i in range(N_FEATURES) if i % 3) + 1
    assert sum(v for k, v in by_lag.items() if k) == sum(1 for i in range(N_FEATURES) if i % 3 == 0 and i % 7)
