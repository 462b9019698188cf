import math

from pyspark.sql import functions as F

from tessera.operators import encode


def test_scalers_on_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "k int, a double, b double")
    for kind in encode.SCALERS:
        out = {r["k"]: r for r in encode.scale(df, ["a", "b"], kind).collect()}
        assert all(out[k]["b"] == 0.0 for k in out)
    std = encode.scale(df, ["a"], "StandardScaler").agg(F.avg("a"), F.stddev_pop("a")).collect()[0]
    assert abs(std[0]) < 1e-12 and abs(std[1] - 1) < 1e-12
    mm = encode.scale(df, ["a"], "MinMaxScaler").agg(F.min("a"), F.max("a")).collect()[0]
    assert (mm[0], mm[1]) == (0.0, 1.0)


def test_robust_iqr_zero_and_linear(spark):
    z = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 0, 7)], "c double")
    assert max(r["c"] for r in encode.scale(z, ["c"], "RobustScaler").collect()) == 7.0
    lin = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 7)], "c double")
    assert max(r["c"] for r in encode.scale(lin, ["c"], "RobustScaler").collect()) == 4.0


def test_all_null_column_dropped_and_nan_is_missing(spark):
    df = spark.createDataFrame([(1, None, 1.0, "a"), (2, None, float("nan"), None), (3, None, 3.0, "b")],
                               "k int, d double, e double, s string")
    enc = encode.preprocess(df, ["k"], "StandardScaler", "Mean")
    assert "d" not in enc.feature_names
    assert enc.feature_names == ["e", "s_Missing", "s_a", "s_b"]  # sorted categories, none dropped
    rows = {r["k"]: r["x"] for r in enc.frame.collect()}
    assert rows[2][0] == 0.0  # NaN imputed with the mean (2.0), then standardised to 0
    assert all(not math.isnan(v) for x in rows.values() for v in x)


def test_mean_imputer_leaves_all_null_column_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, d double")
    fitted = encode.fit_imputer(df, ["d"], "Mean")
    assert fitted.fill["d"] is None
    assert fitted.transform(df, ["d"]).where("d is not null").count() == 0


def test_sparse_one_hot_has_no_limit(spark):
    from pyspark.sql import functions as F
    from tessera.operators.encode import one_hot_sparse
    df = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id") % 1500).alias("a"),
                                  F.when(F.col("id") % 2 == 0, F.lit("x")).alias("b.c"))
    ones, names = one_hot_sparse(df, ["id"], ["a", "b.c"])
    assert names.count() == 1502 and names.agg(F.max("index")).collect()[0][0] == 1501
    index = {(r["column"], r["value"]): r["index"] for r in names.collect()}
    got = {r["id"]: r["indices"] for r in ones.collect()}
    assert got[7] == [index["a", "v7"], index["b.c", "Missing"]] and got[1508] == [index["a", "v8"], index["b.c", "x"]]


def test_wide_correlation(spark):
    import numpy as np
    from tessera.operators.profile import corr_matrix
    x = np.random.default_rng(3).normal(size=(40, 30))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(30)])
    got = {(r["col_a"], r["col_b"]): r["r"] for r in corr_matrix(df).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 900 and all(abs(got[f"c{i}", f"c{j}"] - want[i, j]) < 1e-9 for i in range(30) for j in range(30))
