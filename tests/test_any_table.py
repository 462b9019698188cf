"""Tables as users have them: headers with dots and blanks, ready-made arrays, infinities, odd types."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.exprs import ref
from tessera.operators import encode, features, profile, results
from tessera.plans.clean_job import CleanConfig, run_clean
from tessera.plans.report import build_report
from tessera.plans.train import train
from tessera.sources.csv import load_csv


@pytest.mark.parametrize("imputer", ["Median", "KNN"])
def test_dotted_headers_through_all_steps(spark, tmp_path, imputer):
    lines = ["row.id,se.len,sp wid,spe.cies"]
    for i in range(60):
        g = i % 3
        lines.append(f"{i},{'' if i == 7 else 5 * g + i % 4 / 10},{g * 3 + i % 5 / 10},{['a', 'b', 'c'][g]}")
    path = tmp_path / "d.csv"
    path.write_text("\n".join(lines) + "\n")
    df = load_csv(spark, str(path))
    assert df.columns == ["row.id", "se.len", "sp wid", "spe.cies"]
    clean = run_clean(df, CleanConfig(imputation="KNN" if imputer == "KNN" else imputer, outliers="IQR", exclude=["row.id"]))
    more = features.interaction_feature(features.ratio_feature(clean, "se.len", "sp wid", "r.1"), "se.len", "sp wid", "i.1")
    res = train(more, "row.id", "KMeans", {"n_clusters": 3}, imputer=imputer)
    assert res.labels.columns == ["row.id", "cluster"]
    labelled = results.label_join(more, res.labels, ["row.id"])
    assert labelled.count() == 60
    assert results.cluster_profile(labelled, ["row.id"]).count() == 3
    assert {r["feature"] for r in results.feature_importance(labelled, ["row.id"]).collect()} == {"se.len", "sp wid", "r.1", "i.1"}
    assert results.pair_scatter(labelled, ["row.id"]).columns[0] == "row.id"
    assert results.cluster_describe(labelled, ["row.id"]).count() == 12 and results.cluster_descriptions(labelled, ["row.id"]).count() == 3
    assert profile.describe(more).count() == 5 and profile.corr_matrix(more).count() == 25
    assert build_report(spark, labelled, ["row.id"], res.metrics, "KMeans", imputer, "StandardScaler", "IQR").count() > 0


@pytest.mark.parametrize("algorithm", ["Birch", "MeanShift", "Spectral"])
def test_new_algorithms_are_dispatched(spark, algorithm):
    rows = [(f"k{i:03d}", 9.0 * (i % 2) + i % 5 / 10, 4.0 * (i % 2) + i % 7 / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    params = {"Birch": {"n_clusters": 2}, "MeanShift": {"bandwidth": 1.0}, "Spectral": {"n_clusters": 2, "n_neighbors": 5}}[algorithm]
    res = train(df, "k", algorithm, params)
    assert {r["k"]: r["cluster"] for r in res.labels.collect()} == {f"k{i:03d}": i % 2 for i in range(60)}
    assert res.metrics.first()["clusters"] == 2


def test_arrays_are_ready_made_features(spark):
    rows = [(i, float(i), [float(i % 3), 7.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, a double, `v.1` array<float>")
    enc = encode.preprocess(df, ["id"])
    assert enc.feature_names == ["a", "v.1_0", "v.1_1"] and enc.dim == 3
    got = {r["id"]: r["x"] for r in enc.frame.collect()}
    assert all(got[i][1:] == [i % 3, 7.0] for i in got)
    only = encode.preprocess(df.drop("a"), ["id"])
    assert only.dim == 2 and only.frame.first()["x"][1] == 7.0
    for bad in ("array(1.0)", "array(1.0, null)", "array(1.0, double('inf'))", "cast(null as array<double>)"):
        with pytest.raises(ValueError, match="v.1"):
            encode.preprocess(df.withColumn("v.1", F.when(F.col("id") == 3, F.expr(bad)).otherwise(ref("v.1").cast("array<double>"))), ["id"])


def test_refused_before_fitting(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, a double")
    with pytest.raises(ValueError, match="infinite"):
        encode.preprocess(df.withColumn("a", F.when(F.col("id") == 2, float("inf")).otherwise(F.col("a"))), ["id"])
    with pytest.raises(ValueError, match="neither"):
        encode.preprocess(df.withColumn("s", F.struct("a")), ["id"])
