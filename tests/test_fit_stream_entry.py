import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import evaluate as E
from kindling.operators import fit as FT

SF001 = "/root/testdata/sf0.001"


def separable(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, a double, b double, label int")


def test_logistic_learns(spark):
    df = separable(spark)
    model = FT.fit_logistic(df, ["a", "b"])
    auc = E.auc(FT.score(model, df, "key", "label", "lr")).collect()[0].auc
    assert auc > 0.9


def test_weights_equal_repeated_rows(spark):
    df = separable(spark, n=200, seed=1)
    weighted = FT.fit_logistic(df, ["a", "b"], pos_weight=2.0).stages[-1]
    repeated = FT.fit_logistic(FT.repeat_positives(df, "label", 2), ["a", "b"], pos_weight=1.0).stages[-1]
    assert np.allclose(weighted.coefficients.toArray(), repeated.coefficients.toArray(), atol=1e-4)


def test_stream_scoring(spark, tmp_path):
    from kindling.operators.scoring import DenseNet
    from kindling.streaming import score_stream, start_scoring

    src = spark.read.parquet(f"{SF001}/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(SF001)
    net = DenseNet.random([1, 3, 1], seed=0)
    scored = score_stream(stream, {"value": (50.0, 25.0)}, ["value"], net, key="event_id")
    q = start_scoring(scored, str(tmp_path / "out"), query_name="test_scores")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == src.count()


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 50


def test_evaluation_plan_has_no_single_partition_exchange(spark):
    from kindling.plans import tables as T

    plan = E.evaluation(T.events_scored(spark, SF001), find_best=True)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_balanced_accuracy_identity(spark):
    """On balanced data, acc = (R + 1 - R·(1/P - 1)) / 2."""
    import __spark_entry__ as entry

    r = entry.queries()["flagship"](spark, SF001).collect()[0]
    assert r.tp + r.fn == r.tn + r.fp  # the valid part is balanced
    acc = (r.recall + 1 - r.recall * (1 / r.precision - 1)) / 2
    assert acc == pytest.approx(r.accuracy, abs=2e-6)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    from kindling.plans.queries import QUERIES

    plan = _plan(QUERIES["log_loss"](spark, SF001))
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    from kindling.operators import evaluate as E
    from kindling.plans import tables as T

    plan = _plan(E.log_loss(T.events_scored(spark, SF001, before=T.EVENTS_CUT)))  # the scan of epoch_metrics
    assert "LessThan(ts,2024-01-25T00:00)" in plan and "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # show the whole ReadSchema
    try:
        plan = _plan(QUERIES["feature_groups"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert ("ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double,"
            "l_discount:double,l_tax:double>") in plan
