"""Mean shift: against a plain implementation, planted modes, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import meanshift as M

SCHEMA = "id long, x array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).repartition(5)


def plain(x, h, max_iter=300):
    """Seeds at cell centres climb one after the other; greedy choice by strength."""
    seeds = np.unique(np.round(x / h) + 0.0, axis=0) * h
    rest = []
    for s in seeds:
        for _ in range(max_iter):
            near = x[((x - s) ** 2).sum(axis=1) <= h * h]
            if not len(near):
                break
            to = near.mean(axis=0)
            still = np.sqrt(((to - s) ** 2).sum()) <= 1e-3 * h
            s = to
            if still:
                break
        if len(near):
            rest.append((len(near), *s))
    kept = []
    for r in sorted(rest, reverse=True):
        if all(((np.array(r[1:]) - np.array(k[1:])) ** 2).sum() > h * h for k in kept):
            kept.append(r)
    return np.array(sorted(k[1:] for k in kept))


def blobs(n=70, seed=5, dim=2):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0] * dim, [9.0] + [1.0] * (dim - 1), [1.0] + [8.0] * (dim - 1)])
    return np.concatenate([rng.normal(size=(n, dim)) + c for c in centres]), centres


@pytest.mark.parametrize(("dim", "few"), [(2, 0), (2, 10**6), (1, 10**6), (4, 10**6)])
def test_plain_implementation(spark, monkeypatch, dim, few):
    monkeypatch.setattr(M, "BROADCAST_ROWS", few)
    monkeypatch.setattr(M, "CELL_ROWS", 20)
    x, _ = blobs(dim=dim)
    got = np.array(sorted(r["x"] for r in M.modes(frame(spark, x), 2.5).collect()))
    want = plain(x, 2.5)
    assert got.shape == want.shape and np.allclose(got, want, atol=2.5e-2)


def test_planted_groups_are_labelled(spark):
    x, centres = blobs()
    got = {r["id"]: r["cluster"] for r in M.mean_shift(frame(spark, x), "id", 3.0).collect()}
    near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
    assert got == {i: int(c) for i, c in enumerate(near)}


def test_hot_vector_and_nulls(spark):
    x, _ = blobs(30)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [20.0, 20.0]) for i in range(60)] + [(5000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mean_shift(df, "id", 3.0)
    assert got.count() == 150 and got.where("id >= 1000").select("cluster").distinct().count() == 1
    assert got.select("cluster").distinct().count() == 4


def test_strongest_is_greedy(spark):
    """A chain of modes, each within reach of the next: every second one stays."""
    rows = [(i, [float(i)], 100 - i) for i in range(9)] + [(50, [0.001], 1)]
    got = M.strongest(spark.createDataFrame(rows, "id long, x array<double>, n long"), 1.5)
    assert sorted(r["id"] for r in got.collect()) == [0, 2, 4, 6, 8]


def test_odd_inputs(spark):
    with pytest.raises(ValueError):
        M.modes(spark.createDataFrame([(1, [1.0])], SCHEMA), 0.0)
    assert M.mean_shift(spark.createDataFrame([], SCHEMA), "id", 1.0).count() == 0
    with pytest.raises(ValueError):
        M.modes(spark.createDataFrame([(1, [1.0])], SCHEMA), 1.0, min_bin=2)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], SCHEMA)
    assert M.estimate_bandwidth(df, "id", 1) == 1.0
    assert M.mean_shift(df, "id", 100.0).agg(F.count_distinct("cluster")).first()[0] == 1
