from kindling.operators import history as H


def test_early_stop_case(spark):
    f1 = [0.5, 0.6, 0.6, 0.55, 0.6, 0.9]
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate(f1)], "run long, epoch int, val_f1 double")
    r = H.early_stop(df, "val_f1", patience=3).collect()[0]
    assert (r.best_epoch, r.stop_epoch, r.epochs_run, r.best_metric) == (1, 4, 5, 0.6)


def test_never_improves(spark):
    df = spark.createDataFrame([(1, e, 0.0) for e in range(5)], "run long, epoch int, val_f1 double")
    r = H.early_stop(df, "val_f1", patience=3).collect()[0]
    assert (r.best_epoch, r.stop_epoch, r.best_metric) == (-1, 2, None)


def test_threshold_carry(spark):
    df = spark.createDataFrame([(1, e, 0.1 * (e + 1)) for e in range(5)], "run long, epoch int, s double")
    got = [r.threshold for r in H.threshold_schedule(df, "s", n_epochs=5).orderBy("epoch").collect()]
    assert got == [0.1, 0.1, 0.30000000000000004, 0.30000000000000004, 0.5]


def test_training_curves_long(spark):
    df = spark.createDataFrame([(1, 0, 0.1, 0.2)], "run long, epoch int, train_loss double, val_f1 double")
    assert H.training_curves(df).count() == 2


def test_final_threshold_is_latest_search_up_to_stop(spark):
    f1 = [0.5, 0.6, 0.6, 0.55, 0.6, 0.9]
    df = spark.createDataFrame([(1, e, v, 0.1 * (e + 1)) for e, v in enumerate(f1)],
                               "run long, epoch int, val_f1 double, s double")
    sched = H.threshold_schedule(df, "s", n_epochs=6)
    r = H.early_stop(sched, "val_f1", patience=3).collect()[0]
    # searched at epochs 0, 2, 4 (and 5, never reached); stopped after epoch 4
    assert r.stop_epoch == 4 and r.final_threshold == 0.5
