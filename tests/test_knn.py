import numpy as np
import pytest

from tessera.operators import knn
from tessera.operators.knn import knn_impute


def brute(X, k=5):
    n, p = X.shape
    out = X.copy()
    means = np.nanmean(X, axis=0)
    for i in range(n):
        for c in range(p):
            if not np.isnan(X[i, c]):
                continue
            cands = []
            for j in range(n):
                if np.isnan(X[j, c]):
                    continue
                both = ~np.isnan(X[i]) & ~np.isnan(X[j])
                if both.sum() == 0:
                    continue
                d2 = ((X[i, both] - X[j, both]) ** 2).sum() * p / both.sum()
                cands.append((d2, j))
            cands.sort()
            out[i, c] = np.mean([X[j, c] for _, j in cands[:k]]) if cands else means[c]
    return out


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 3))
    X[rng.random((60, 3)) < 0.2] = np.nan
    X[5] = np.nan  # a row with no coordinates at all -> column means
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    got = knn_impute(df, ["k"], ["a", "b", "c"], k=5, block_rows=16)
    G = np.array([[r["a"], r["b"], r["c"]] for r in got.orderBy("k").collect()])
    assert np.allclose(G, brute(X), atol=1e-12)


@pytest.mark.parametrize("joins", [0, 100])
def test_patterns_and_blocks_agree_with_ties_and_string_keys(spark, monkeypatch, joins):
    """Few distinct values, so that distances tie; the smaller key wins."""
    monkeypatch.setattr(knn, "MAX_JOINS", joins)
    rng = np.random.default_rng(4)
    X = rng.integers(0, 4, size=(150, 3)).astype(float)
    X[:70, 0], X[50:90, 1] = np.nan, np.nan
    X[0] = np.nan
    rows = [(f"k{i:03d}", i % 2, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, j int, `a.x` double, b double, c double")
    got = knn_impute(df, ["k", "j"], ["a.x", "b", "c"], k=5, block_rows=8, leaf_rows=6)
    assert got.columns == df.columns
    G = np.array([list(r)[2:] for r in got.orderBy("k").collect()])
    assert np.allclose(G, brute(X), atol=1e-12)
