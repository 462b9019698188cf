import numpy as np
import pytest

from tessera.operators import features


def test_ratio_zero_and_tiny_denominators(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, -1e-9), (3, 4.0, 2.0)], "k int, a double, b double")
    out = {r["k"]: r["a_per_b"] for r in features.ratio_feature(df, "a", "b").collect()}
    assert out[1] is None and out[2] is None
    assert abs(out[3] - 4.0 / (2.0 + 1e-9)) < 1e-12


def test_duplicate_feature_name_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        features.interaction_feature(df.withColumn("a_x_b", df.a), "a", "b")


def test_pca_two_columns_closed_form(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    b = 0.6 * a + rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    r = abs(np.corrcoef(a, b)[0, 1])
    got = [row["individual_pct"] for row in features.pca_explained(df).orderBy("component").collect()]
    assert abs(got[0] - (1 + r) / 2 * 100) < 1e-9 and abs(got[1] - (1 - r) / 2 * 100) < 1e-9


def test_pca_projection_matches_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(100, 3)) @ np.array([[2, 0, 0], [0.5, 1, 0], [0, 0.2, 0.3]])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "k int, x array<double>")
    got = np.array([[r["pc1"], r["pc2"]] for r in features.pca_project_2d(df, ["k"], 3).orderBy("k").collect()])
    Xc = X - X.mean(0)
    w, v = np.linalg.eigh(np.cov(Xc.T, bias=True))
    comps = v[:, np.argsort(w)[::-1][:2]]
    for j in range(2):
        if comps[np.argmax(np.abs(comps[:, j])), j] < 0:
            comps[:, j] *= -1
    assert np.allclose(got, Xc @ comps, atol=1e-9)
