from kindling.operators import catalog as C


def test_lag_names(spark):
    names = C.names_frame(spark, ["t_lag_1", "t_lag_0", "flag_x", "t_lag1", "lag_x_lag_2", "plain", "is_fire",
                                  "a_LAG_-3", "b_lag_ 4", "c_lag_3.0", "d_lag_7d"])
    got = {r.feature: r.lag for r in C.lag_catalog(names).collect()}
    assert got == {"t_lag_1": 1, "lag_x_lag_2": 2, "plain": 0, "a_LAG_-3": -3, "b_lag_ 4": 4}
    kept = {r.feature: r.lag for r in C.lag_catalog(names, keep_lag_zero=True).collect()}
    assert kept["t_lag_0"] == 0


def test_group_overlap_and_other(spark):
    names = C.names_frame(spark, ["temp_wind", "ndvi", "elev", "is_fire", "Temporal"])
    got = sorted((r.feature, r.group) for r in C.feature_group_catalog(names).collect())
    assert got == [("Temporal", "temperature"), ("elev", "other"), ("ndvi", "vegetation"),
                   ("temp_wind", "temperature"), ("temp_wind", "wind")]


def test_feature_rank_orders_by_abs_corr(spark):
    rows = [(float(i), float(-2 * i + (i % 3)), float(i % 2), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    got = [r.feature for r in C.feature_rank(df, ["a", "b", "c"], "y", top=2).collect()]
    assert len(got) == 2 and got[0] == "c"


def test_group_profile(spark):
    long = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), ("b", float("nan")), ("c", None)],
                                 "feature string, value double")
    cat = spark.createDataFrame([("a", "g"), ("b", "g"), ("b", "h"), ("c", "n")], "feature string, group string")
    got = {r.group: r for r in C.group_profile(long, cat).collect()}
    r = got["g"]
    assert (r.n_values, r.n_null, r.mean, r["std"], r.min, r.max) == (4, 2, 2.0, 1.0, 1.0, 3.0)
    assert (got["h"].n_values, got["h"].mean, got["h"]["std"]) == (2, 3.0, 0.0)
    assert (got["n"].n_values, got["n"].n_null, got["n"].mean, got["n"]["std"]) == (1, 1, None, None)


def test_feature_rank_dotted_names_and_empty_input(spark):
    df = spark.createDataFrame([(float(i), float(-i), 1.0, i % 2) for i in range(9)], "`a.b` double, c double, k double, y int")
    got = C.feature_rank(df, ["a.b", "c", "k"], "y", top=3).collect()
    assert {r.feature for r in got} == {"a.b", "c", "k"}
    assert len(C.feature_rank(df.limit(0), ["a.b", "c"], "y").collect()) == 2
