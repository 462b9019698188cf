"""Birch: totals whatever the order, bounded trees, radii, planted groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import birch as B


def rows_of(cf):
    return int(cf.n.sum()), cf.ls.sum(axis=0).tolist(), float(cf.ss.sum())


def points(x):
    return B.CF(np.ones(len(x), np.int64), x, (x * x).sum(axis=1))


@pytest.mark.parametrize("max_clusters", [1, 7, 5000])
@pytest.mark.parametrize("threshold", [0.0, 3.0])
def test_totals_do_not_depend_on_the_order(threshold, max_clusters):
    """Whole numbers, so that sums are exact in any order."""
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, size=(900, 3)).astype(float)
    for seed in range(3):
        parts = np.array_split(np.random.default_rng(seed).permutation(x), 1 + seed * 3)
        trees = []
        for p in parts:
            t = B.CFTree(3, threshold, 5, max_clusters)
            t.insert(points(p))
            assert t.size == len(t.leaves()) <= max_clusters
            trees.append(t)
        whole = B.CFTree(3, max(t.threshold for t in trees), 5, max_clusters)
        for t in reversed(trees):
            whole.insert(t.leaves())
        assert rows_of(whole.leaves()) == rows_of(points(x))


def test_radius_stays_within_the_threshold():
    rng = np.random.default_rng(2)
    t = B.CFTree(2, 0.4, 4, 100_000)
    for _ in range(20):
        t.insert(points(rng.normal(size=(300, 2))))
    found = t.leaves()
    assert np.sqrt(found.spread()).max() <= 0.4 + 1e-9 and 20 < len(found) < 6000


def test_tree_nodes_hold_their_children(spark):
    rng = np.random.default_rng(3)
    t = B.CFTree(2, 0.2, 3, 100_000)
    t.insert(points(rng.normal(size=(1500, 2))))

    def check(node, depth=0):
        assert len(node.cf) <= 3
        for i, child in enumerate(node.children):
            assert np.allclose(child.cf.total().ls, node.cf.ls[i]) and child.cf.n.sum() == node.cf.n[i]
            check(child, depth + 1)
    check(t.root)


def blobs(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    centres = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = [(i, [float(v) for v in rng.normal(size=2) + centres[i % 3]]) for i in range(3 * n)]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(7)


def test_planted_groups(spark):
    got = {r["id"]: r["cluster"] for r in B.birch(blobs(spark), "id", 3).collect()}
    assert got == {i: i % 3 for i in range(180)}


def test_merges_many_tasks_with_a_small_bound(spark):
    df = blobs(spark, 400)
    micro = B.micro_clusters(df, 0.1, 4, max_clusters=25, fan_in=2)
    total = micro.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum(F.col("ls")[0]).alias("s"), F.sum("ss").alias("q")).first()
    plain = df.agg(F.sum(F.col("x")[0]), F.sum(F.col("x")[0] ** 2 + F.col("x")[1] ** 2)).first()
    assert total["m"] <= 25 and total["n"] == 1200
    assert total["s"] == pytest.approx(plain[0]) and total["q"] == pytest.approx(plain[1])
    assert sorted(r["n"] for r in B.birch(df, "id", 3, 0.1, 4, 25).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()) == [400] * 3


def test_odd_inputs(spark):
    schema = "id long, x array<double>"
    assert B.micro_clusters(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(99, None)], schema)
    one = B.micro_clusters(same, 0.0).collect()
    assert len(one) == 1 and one[0]["n"] == 50
    with pytest.raises(ValueError):
        B.birch(same.where("x is not null"), "id", 2)
    with pytest.raises(ValueError):
        B.micro_clusters(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))
