from pyspark.sql import functions as F

from tessera.operators import clean


def _df(spark):
    rows = [(i, float(i) if i % 3 else None, "x" if i % 4 else None) for i in range(1, 21)]
    return spark.createDataFrame(rows, "k int, v double, s string")


def test_imputation_fills_only_gaps(spark):
    df = _df(spark)
    for strategy in ("Mean", "Median", "KNN"):
        out = {r["k"]: r for r in clean.impute(df, strategy, exclude=["k"]).collect()}
        assert all(r["v"] is not None and r["s"] is not None for r in out.values())
        for r in df.collect():
            if r["v"] is not None:
                assert out[r["k"]]["v"] == r["v"]
    knn = {r["k"]: r["v"] for r in clean.impute(df, "KNN", exclude=["k"]).collect()}
    mean = {r["k"]: r["v"] for r in clean.impute(df, "Mean", exclude=["k"]).collect()}
    assert knn == mean  # single-column KNN has no coordinates: it is the mean


def test_zscore_constant_column_removes_every_row(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert clean.zscore_filter(df).count() == 0


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    out = clean.clip_percentiles(df)
    assert out.where(F.col("v").isNull()).count() == 1
    assert out.agg(F.min("v")).collect()[0][0] == 0.99


def test_drop_rows_any_column(spark):
    assert clean.drop_rows(_df(spark)).where("v is null or s is null").count() == 0


def test_nan_is_missing_everywhere(spark):
    import math
    from tessera.operators import clean, profile
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, math.nan), (4, 4.0), (5, None)], "k long, v double")
    d = profile.describe(df, ["v"]).collect()[0]
    assert (d["count"], d["mean"], d["max"]) == (3, 7 / 3, 4.0) and not math.isnan(d["std"])
    o = {r["column"]: r for r in profile.column_overview(df, "k").collect()}["v"]
    assert (o["missing"], o["unique"]) == (2, 3)
    assert profile.histogram(df, "v").agg({"count": "sum"}).collect()[0][0] == 3
    assert profile.outlier_counts(df, "v").collect()[0]["n"] == 3
    assert clean.zscore_filter(df, ["k"]).count() == 3 and clean.iqr_filter(df, ["k"]).count() == 3
    assert [r["v"] for r in clean.clip_percentiles(df, exclude=["k"]).orderBy("k").collect()][2] is None
    assert all(r["r"] is None or not math.isnan(r["r"]) for r in profile.corr_matrix(df).collect())
