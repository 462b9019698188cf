"""Nearest-neighbour join and k-distance: against all distances."""

import numpy as np
import pytest

from tessera.operators import neighbours as N

SCHEMA = "id long, x array<double>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], SCHEMA)


def brute(q, p, k, exclude_self):
    out = {}
    for i, a in enumerate(q):
        d = []
        for j, b in enumerate(p):
            if exclude_self and i == j:
                continue
            s = 0.0
            for u, v in zip(a, b, strict=True):
                s += (u - v) * (u - v)
            d.append((s, j))
        out[i] = [(r + 1, j, s) for r, (s, j) in enumerate(sorted(d)[:k])]
    return out


def got(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["rank"], r["nb"], r["d2"]))
    return out


@pytest.mark.parametrize("leaf_rows", [7, 40, 100_000])
@pytest.mark.parametrize("dim", [1, 3, 9])
def test_all_distances(spark, leaf_rows, dim):
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.normal(size=(150, dim)), rng.normal(size=(60, dim)) * 0.01 + 5, rng.normal(size=(10, dim)) * 100])
    f = frame(spark, x)
    assert got(N.nearest(f, f, 4, exclude_self=True, leaf_rows=leaf_rows)) == brute(x, x, 4, True)


def test_ties_repeats_and_hot_vectors(spark):
    """A third of the rows are one vector; whole coordinates tie everywhere."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.full((90, 2), 2.0), rng.integers(0, 5, size=(180, 2))]).astype(float)
    x = x[rng.permutation(len(x))]
    f = frame(spark, x)
    assert got(N.nearest(f, f, 5, exclude_self=True, leaf_rows=5)) == brute(x, x, 5, True)


def test_other_points_far_away(spark):
    rng = np.random.default_rng(9)
    q, p = rng.normal(size=(50, 2)) * 10 + 100, rng.normal(size=(300, 2))
    assert got(N.nearest(frame(spark, q), frame(spark, p), 3, leaf_rows=10)) == brute(q, p, 3, False)


def test_few_points_and_none(spark):
    x = np.array([[0.0], [1.0], [3.0]])
    f = frame(spark, x)
    assert got(N.nearest(f, f, 5, exclude_self=True)) == brute(x, x, 5, True)
    assert N.nearest(f, f.where("id < 0"), 2).count() == 0 and N.nearest(f.where("id < 0"), f, 2).count() == 0
    d = {r["id"]: r["k_distance"] for r in N.k_distance(f, "id", 2).collect()}
    assert d == {0: 3.0, 1: 2.0, 2: 3.0}
    assert {r["k_distance"] for r in N.k_distance(f, "id", 3).collect()} == {None}


def test_boxes_visited_are_few_and_enough():
    """Neighbours cost a few boxes a query, not all points."""
    rng = np.random.default_rng(10)
    x = rng.random(size=(4000, 2))
    boxes = N._grown(x, 80)
    leaf, n = boxes.leaf_of(x), len(boxes.axis) + 1
    assert 60 <= n <= 200 and set(leaf) == set(range(n)) and np.bincount(leaf).max() <= 100
    boxes.lo, boxes.hi = (np.array([f(x[leaf == i], axis=0) for i in range(n)]) for f in (np.min, np.max))
    boxes.close_inner()
    row, to = boxes.within(x, np.full(len(x), 0.02 ** 2))
    assert len(row) < 3 * len(x)
    visited = set(zip(row.tolist(), to.tolist(), strict=True))
    d2 = ((x[:500, None] - x[None]) ** 2).sum(-1)
    assert all((i, leaf[j]) in visited for i, j in zip(*np.nonzero(d2 <= 0.02 ** 2), strict=True))


def test_curve_and_knee(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(300, 2)) * 0.1, rng.random(size=(15, 2)) * 20 + 5])
    d = N.k_distance(frame(spark, x), "id", 4)
    curve = N.k_distance_curve(d, "id").orderBy("position").collect()
    assert [r["position"] for r in curve] == list(range(315))
    assert [r["k_distance"] for r in curve] == sorted(r["k_distance"] for r in curve)
    eps = N.suggest_eps(d)
    inner = sorted(np.sqrt(((x[:300, None] - x[None, :300]) ** 2).sum(-1)), key=lambda r: r[0])
    assert np.quantile([np.sort(r)[4] for r in inner], 0.9) <= eps < 4
    assert N.suggest_eps(d.where("id < 0")) is None
