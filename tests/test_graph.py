import numpy as np
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components, dense_index


def np_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def test_components_across_many_tasks(spark):
    rng = np.random.default_rng(14)
    n = 400
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, size=(300, 2))]
    edges += [(i, i + 1) for i in range(100, 160)]  # a long path
    v = spark.range(n)
    e = spark.createDataFrame(edges, "src long, dst long")
    want = np_components(n, edges)
    for per_task in (10_000, 25):  # one task, then many tasks and several levels
        got = {r["id"]: r["root"] for r in connected_components(v, e, max_edges_per_task=per_task).collect()}
        assert [got[i] for i in range(n)] == want


def test_long_path_converges_in_logarithmic_levels(spark):
    from tessera.operators import graph
    n = 5_000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(spark.range(n), e, max_edges_per_task=50).agg(
        F.count("id").alias("n"), F.max("root").alias("m")).collect()[0]
    assert (got["n"], got["m"]) == (n, 0)
    assert graph.LAST_ROUNDS < 20


def test_dense_index_is_global_rank(spark):
    df = spark.createDataFrame([(int(x),) for x in (50, 3, 3, 900, 7, 50, 1)], "r long")
    got = {r["r"]: r["idx"] for r in dense_index(df, "r", partitions=3).collect()}
    assert got == {1: 0, 3: 1, 7: 2, 50: 3, 900: 4}
    assert dense_index(df, "r").agg(F.max("idx")).collect()[0][0] == 4
