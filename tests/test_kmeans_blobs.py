import numpy as np

from tessera.operators.agglomerative import agglomerative
from tessera.operators.dbscan import dbscan
from tessera.operators.kmeans import assign, kmeans, kmeans_fit


def blobs(spark):
    rng = np.random.default_rng(42)
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    X = np.vstack([c + rng.normal(size=(30, 2)) * 0.5 for c in centres])
    truth = np.repeat([0, 1, 2], 30)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(90)], "k long, x array<double>")
    return df, X, truth


def _same_partition(a, b):
    pairs = {}
    for x, y in zip(a, b):
        if pairs.setdefault(x, y) != y:
            return False
    return len(set(pairs.values())) == len(pairs)


def test_all_algorithms_recover_blobs(spark):
    df, X, truth = blobs(spark)
    for lab_df in (kmeans(df, "k", 3), dbscan(df, "k", 1.5, 5), agglomerative(df, "k", 3, "ward")):
        got = [r["cluster"] for r in lab_df.orderBy("k").collect()]
        assert _same_partition(got, truth)


def test_assignment_is_nearest_centre_and_canonical(spark):
    df, X, _ = blobs(spark)
    fit = kmeans_fit(df, "k", 3)
    C = np.array(fit.centres)
    got = np.array([r["cluster"] for r in assign(df, fit.centres).orderBy("k").collect()])
    want = np.argmin(((X[:, None] - C[None]) ** 2).sum(-1), axis=1)
    assert (got == want).all()
    assert got[0] == 0  # canonical numbering starts with the cluster of the smallest key


def test_lloyd_steps_match_numpy_and_run_few_tasks(spark):
    import numpy as np

    from tessera.operators.kmeans import _lloyd, side_by_side
    rng = np.random.default_rng(31)
    X = rng.normal(size=(500, 3))
    start = [*X[:4].tolist(), [90.0, 90.0, 90.0]]  # the last centre never gets a row
    at, steps = np.array(start), 0
    while True:
        steps += 1
        d2 = ((X[:, None] - at[None]) ** 2).sum(-1)
        near, cost = d2.argmin(1), d2.min(1).sum()
        new = np.array([X[near == c].mean(0) if (near == c).any() else at[c] for c in range(5)])
        moved, at = ((new - at) ** 2).sum(1).max(), new
        if moved <= 1e-8:
            break
    rows = spark.createDataFrame([(x.tolist(),) for x in X], "x array<double>").repartition(3)
    got, other = side_by_side(rows, [lambda: _lloyd(rows, start, 300, 1e-4), lambda: _lloyd(rows, start, 2, 0.0)])
    assert np.allclose(got[0], at) and np.isclose(got[1], cost) and got[2] == steps
    assert other[2] == 2 and other[0][4] == [90.0, 90.0, 90.0]
