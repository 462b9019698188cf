import numpy as np
from pyspark.sql import functions as F

from tessera.operators.dbscan import dbscan, neighbour_counts


def sequential_dbscan(X, eps, min_samples):
    """Independent model: grow clusters visiting points in index order."""
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = [np.flatnonzero(D[i] <= eps) for i in range(n)]
    core = np.array([len(v) >= min_samples for v in nb])
    lab = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        stack = [i]
        lab[i] = c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if lab[q] == -1:
                    lab[q] = c
                    stack.append(q)
        c += 1
    return lab


def _frame(spark, X):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "k long, x array<double>")


def _labels(df):
    return np.array([r["cluster"] for r in df.orderBy("k").collect()])


def test_matches_sequential_model(spark):
    rng = np.random.default_rng(4)
    for trial in range(4):
        X = np.vstack([rng.normal(size=(40, 2)) * 0.3 + rng.normal(size=2) * 2 for _ in range(3)])
        X = np.vstack([X, rng.uniform(-4, 4, size=(15, 2))])
        eps, ms = 0.35 + 0.05 * trial, 4 + trial
        got = _labels(dbscan(_frame(spark, X), "k", eps, ms))
        assert (got == sequential_dbscan(X, eps, ms)).all()


def test_border_point_takes_lower_cluster(spark):
    # two dense groups; point 10 is within eps of a core point of each, but not core itself
    left = [[0.0, 0.0], [0.1, 0.0], [0.0, 0.1], [0.1, 0.1], [0.05, 0.05]]
    right = [[2.0, 0.0], [2.1, 0.0], [2.0, 0.1], [2.1, 0.1], [2.05, 0.05]]
    X = np.array(left + right + [[1.0, 0.05]])
    got = _labels(dbscan(_frame(spark, X), "k", 0.91, 5))
    assert got[10] == 0 and set(got[:5]) == {0} and set(got[5:10]) == {1}
    assert (got == sequential_dbscan(X, 0.91, 5)).all()


def test_one_cluster_and_all_noise(spark):
    X = np.random.default_rng(5).normal(size=(30, 3))
    assert set(_labels(dbscan(_frame(spark, X), "k", 100.0, 2))) == {0}
    assert set(_labels(dbscan(_frame(spark, X), "k", 1e-6, 2))) == {-1}


def test_partitioning_and_salting_do_not_change_labels(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(120, 2))
    df = _frame(spark, X)
    base = _labels(dbscan(df, "k", 0.3, 4))
    assert (_labels(dbscan(df.repartition(13), "k", 0.3, 4)) == base).all()
    assert (_labels(dbscan(df.repartition(1), "k", 0.3, 4, max_cell_rows=7)) == base).all()


def test_neighbour_counts_include_self(spark):
    X = np.array([[0.0], [0.5], [3.0]])
    got = {r["k"]: r["n_neighbors"] for r in neighbour_counts(_frame(spark, X), "k", 0.6).collect()}
    assert got == {0: 2, 1: 2, 2: 1}


def test_hot_duplicate_value(spark):
    # a third of the rows share one feature vector: collapsed into one unit
    rng = np.random.default_rng(11)
    X = np.vstack([np.tile([[1.0, 1.0]], (40, 1)), rng.normal(size=(80, 2)) * 0.6])
    for eps, ms in ((0.3, 5), (0.5, 50)):
        got = _labels(dbscan(_frame(spark, X), "k", eps, ms))
        assert (got == sequential_dbscan(X, eps, ms)).all()
    counts = {r["k"]: r["n_neighbors"] for r in neighbour_counts(_frame(spark, X), "k", 0.3).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert all(counts[i] == int((D[i] <= 0.3).sum()) for i in range(len(X)))


def test_within_matches_brute_force(spark):
    from tessera.operators.pairs import within
    rng = np.random.default_rng(21)
    for dim in (1, 3):
        X = rng.normal(size=(900, dim))
        near = (((X[:, None] - X[None]) ** 2).sum(-1)) <= 0.49
        c = rng.integers(0, 6, size=len(X))
        rows = spark.createDataFrame([(i, x.tolist(), int(v)) for i, (x, v) in enumerate(zip(X, c, strict=True))], "id long, x array<double>, v long")
        axes = [0, dim - 1] if dim > 1 else [0]
        total = {r["id"]: r["v"] for r in within(rows, rows, 0.7, axes, "total", 300).collect()}
        assert total == dict(enumerate((near @ c).tolist()))
        least = {r["id"]: r["v"] for r in within(rows.where("id < 50"), rows.where("v > 2"), 0.7, axes, "least", 300).collect()}
        assert least == {i: int(c[near[i] & (c > 2)].min()) for i in range(50) if (near[i] & (c > 2)).any()}
        links = {(r["src"], r["dst"]) for r in within(rows, rows, 0.7, axes, "links").collect()}
        a, b = np.nonzero(near)
        assert links == {(int(c[i]), int(c[j])) for i, j in zip(a, b, strict=True) if c[i] < c[j]}


def test_links_over_corners_first_give_the_same_labels(spark, monkeypatch):
    from tessera.operators import dbscan as module
    monkeypatch.setattr(module, "REP_ROWS", 0)
    rng = np.random.default_rng(22)
    X = np.vstack([rng.normal(size=(60, 3)) * 0.3 + rng.normal(size=3) * 2 for _ in range(3)] + [rng.uniform(-4, 4, size=(20, 3))])
    for eps, ms in ((0.4, 4), (0.9, 6)):
        assert (_labels(dbscan(_frame(spark, X), "k", eps, ms)) == sequential_dbscan(X, eps, ms)).all()


def test_crowded_cells_of_few_ids(spark):
    """Links take a cube's number as id: a crowded cell may hold fewer ids than it has parts."""
    from tessera.operators.pairs import within
    rng = np.random.default_rng(23)
    X, c = rng.uniform(0, 0.9, size=(400, 3)), np.repeat([3, 8], 200)
    rows = spark.createDataFrame([(int(v), x.tolist(), int(v)) for x, v in zip(X, c, strict=True)], "id long, x array<double>, v long")
    assert {(r["src"], r["dst"]) for r in within(rows, rows, 1.0, [0, 1], "links", 50).collect()} == {(3, 8)}
    one = spark.createDataFrame([(7, [0.1, 0.1, 0.1], 1)] * 40, "id long, x array<double>, v long")  # all in one part of four
    assert {(r["src"], r["dst"]) for r in within(one, rows, 2.0, [0, 1], "links", 10).collect()} == {(1, 3), (1, 8)}
    assert [r["v"] for r in within(one, rows, 2.0, [0, 1], "total", 10).collect()] == [int(c.sum())] * 40


def test_dense_rows_leave_no_pairs(spark):
    # 6,000 rows within eps of each other: 18 million pairs, none of which may reach a shuffle
    from pyspark.sql import functions as F
    df = spark.range(6000).select(F.col("id").alias("k"), F.array(*[F.rand(s) * 0.1 for s in (1, 2, 3)]).alias("x"))
    plan = neighbour_counts(df, "k", 1.0)
    got = plan.groupBy("n_neighbors").count().collect()
    assert [(r["n_neighbors"], r["count"]) for r in got] == [(6000, 6000)]
    assert dbscan(df, "k", 1.0, 6000).groupBy("cluster").count().collect()[0].asDict() == {"cluster": 0, "count": 6000}


def test_rows_without_numbers_are_noise(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, [0.1 * i, 0.0]) for i in range(5)] + [(9, [nan, 0.0]), (10, [float("inf"), 0.0])], "k long, x array<double>")
    assert _labels(dbscan(df, "k", 0.5, 3)).tolist() == [0] * 5 + [-1, -1]
