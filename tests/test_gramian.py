"""Second moments of wide tables against numpy, distinct sketches."""

import numpy as np
import pytest

from tessera.operators import features, gramian, profile


def wide(rows, cols, seed, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, cols)) @ np.diag(rng.random(cols) * 10) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=rows)
    x[:, 2] = 7.25
    x[rng.random(x.shape) < gaps] = np.nan
    return x


def frame(spark, x, name="c.{}"):
    schema = ", ".join(f"`{name.format(i)}` double" for i in range(x.shape[1]))
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], schema).repartition(4)


def by_pairs(x):
    p = x.shape[1]
    out = np.full((p, p), np.nan)
    for i in range(p):
        for j in range(p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) and a.std() > 0 and b.std() > 0:
                out[i, j] = np.corrcoef(a, b)[0, 1]
    return out


def test_500_columns_in_one_scan(spark):
    x = wide(300, 500, 1)
    df = frame(spark, x)
    got = gramian.column_moments(df, [profile.ref(c) for c in df.columns]).correlation()
    sample = np.r_[0:12, 480:500]
    want = by_pairs(x[:, sample])
    assert np.allclose(got[np.ix_(sample, sample)], want, atol=1e-9, equal_nan=True)
    assert np.isnan(got[2]).all() and not np.isnan(np.delete(np.delete(got, 2, 0), 2, 1)).any()


def test_wide_and_narrow_correlations_agree(spark, monkeypatch):
    x = wide(200, 9, 2, 0.3)
    x[:150, 4], x[150:, 5] = np.nan, np.nan  # never present together
    df = frame(spark, x)
    narrow = {(r["col_a"], r["col_b"]): r["r"] for r in profile.corr_matrix(df).collect()}
    wide_ = {(r["col_a"], r["col_b"]): r["r"] for r in profile.corr_gramian(df).collect()}
    assert narrow.keys() == wide_.keys()
    assert all((narrow[k] is None) == (wide_[k] is None) and (narrow[k] is None or abs(narrow[k] - wide_[k]) < 1e-8) for k in narrow)
    monkeypatch.setattr(profile, "PAIRS_IN_ONE", 3)
    high = [(r["col_a"], r["col_b"]) for r in profile.high_corr_pairs(df, 0.9).collect()]
    assert high == [("c.0", "c.1")]


def test_wide_pca(spark, monkeypatch):
    x = wide(150, 8, 3, 0.0)
    df = frame(spark, x, "v{}")
    plain = [tuple(r) for r in features.pca_explained(df).collect()]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    flat = {r["id"]: (r["pc1"], r["pc2"]) for r in features.pca_project_2d(rows, ["id"], 8).collect()}
    monkeypatch.setattr(features, "WIDE", 2)
    assert np.allclose([tuple(r) for r in features.pca_explained(df).collect()], plain, atol=1e-8)
    again = {r["id"]: (r["pc1"], r["pc2"]) for r in features.pca_project_2d(rows, ["id"], 8).collect()}
    assert all(np.allclose(again[i], flat[i], atol=1e-6) for i in flat)


def test_no_rows(spark):
    m = gramian.moments(spark.createDataFrame([], "x array<double>"), profile.F.col("x"), 3)
    assert m.n.sum() == 0 and np.isnan(m.correlation()).all()


@pytest.mark.parametrize("rows", [0, 400])
def test_distinct_counts_by_sketch(spark, rows):
    data = [(i, f"n{i}", 5.0, i % 7, None, None if i == 3 else float(i), -0.0 if i % 2 else 0.0) for i in range(rows)]
    df = spark.createDataFrame(data, "`a.id` long, name string, const double, few int, none string, gap double, zero double")
    got = {r["column"]: (r["unique"], r["rows"]) for r in profile.auto_remove(df).collect()}
    if rows:
        assert got == {"a.id": (400, 400), "name": (400, 400), "const": (1, 400), "none": (0, 400), "zero": (1, 400)}
    else:
        assert set(got) == set(df.columns)
