"""Embedding near-duplicates against all cosines."""
import numpy as np
import pytest

from tessera.llm.embedding_dedup import _merge, buckets, near_vectors


def brute(rows, threshold=0.9):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids = sorted({i for i, _ in rows if i is not None})
    root, links = np.arange(len(ids)), [0] * len(rows)
    a, b = [], []
    for k in ok:
        for m in ok:
            x, y = np.array(rows[k][1], float), np.array(rows[m][1], float)
            if k != m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[k] += 1
                a.append(ids.index(rows[k][0]))
                b.append(ids.index(rows[m][0]))
    _merge(root, np.array(a, int), np.array(b, int))
    comp = [None if i is None else ids[root[ids.index(i)]] for i, _ in rows]
    return sorted(((i, n, c, i is not None and i == c) for (i, _), n, c in zip(rows, links, comp, strict=True)), key=str)


def check(df, rows, **options):
    assert sorted((tuple(r) for r in near_vectors(df, **options).collect()), key=str) == brute(rows)


def test_groups_and_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(60)]
    for g in range(4):  # groups around a centre, one of equal vectors
        c = rng.normal(size=16)
        rows += [(100 * g + 100 + k, (c + (0.12 if g else 0) * rng.normal(size=16)).tolist()) for k in range(30)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16), (905, [float("inf")] * 16),
             (906, [1.0, 2.0]), (907, [2.0, 4.0]), (907, [2.0, 4.0]), (907, [-1.0, 0.0]), (None, [1.0, 2.0]), (908, [1e100, 1e100])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, h int")
    check(df, rows, hashes=1, tables=8, block=16)  # buckets of many blocks
    check(df, rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a, o = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * o
    for hashes in (2, 3):
        tables = 3 + 3 * 2 ** (hashes - 1)
        x, y = (buckets(v, tables, hashes, hashes).reshape(2000, tables, hashes) for v in (a, b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() > 0.99


@pytest.mark.parametrize("dim", [384, 768, 1536])
def test_recall_of_wide_vectors(dim):
    rng = np.random.default_rng(dim)
    a, o = rng.normal(size=(2, 400, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * o
    for hashes in (2, 3):
        tables = 3 + 3 * 2 ** (hashes - 1)
        x, y = (buckets(v, tables, hashes, hashes).reshape(400, tables, hashes) for v in (a, b))
        assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.9


def test_lengths_do_not_mix_in_buckets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim in (2, 64, 512, 768, 1024, 1536):
        c = rng.normal(size=dim)
        rows += [(len(rows) + k, (c + 0.05 * rng.normal(size=dim)).tolist()) for k in range(6)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)
    keys = {d: set(buckets(np.eye(1, d), 8, 3, 3).ravel().tolist()) for d in (64, 512, 513, 1024, 40000)}
    assert all(not keys[a] & keys[b] for a in keys for b in keys if a < b)
