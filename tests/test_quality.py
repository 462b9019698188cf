import numpy as np

from tessera.operators import quality


def np_silhouette(X, lab):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(s))


def np_db(X, lab):
    cs = sorted(set(lab))
    C = np.array([X[lab == c].mean(0) for c in cs])
    S = np.array([np.linalg.norm(X[lab == c] - C[i], axis=1).mean() for i, c in enumerate(cs)])
    r = []
    for i in range(len(cs)):
        r.append(max((S[i] + S[j]) / np.linalg.norm(C[i] - C[j]) for j in range(len(cs)) if j != i))
    return float(np.mean(r))


def np_ch(X, lab):
    cs = sorted(set(lab))
    m = X.mean(0)
    W = sum(((X[lab == c] - X[lab == c].mean(0)) ** 2).sum() for c in cs)
    B = sum((lab == c).sum() * ((X[lab == c].mean(0) - m) ** 2).sum() for c in cs)
    return float(B * (len(X) - len(cs)) / (W * (len(cs) - 1)))


def _df(spark, X, lab):
    return spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i])) for i in range(len(X))],
                                 "k long, x array<double>, cluster int")


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(90, 4))
    lab = rng.integers(0, 4, size=90)
    lab[0] = 7  # a singleton cluster: its silhouette is 0
    df = _df(spark, X, lab)
    assert abs(quality.silhouette(df, "k", block_rows=20).collect()[0][0] - np_silhouette(X, lab)) < 1e-9
    assert abs(quality.davies_bouldin(df, "k").collect()[0][0] - np_db(X, lab)) < 1e-9
    assert abs(quality.calinski_harabasz(df, "k").collect()[0][0] - np_ch(X, lab)) < 1e-6


def test_noise_excluded_and_single_cluster_is_null(spark):
    X = np.random.default_rng(10).normal(size=(20, 2))
    lab = np.array([0] * 15 + [-1] * 5)
    df = _df(spark, X, lab)
    assert quality.silhouette(df, "k").collect()[0][0] is None
    counts = quality.cluster_counts(df).collect()[0]
    assert (counts["clusters"], counts["noise"]) == (1, 5)


def test_many_clusters(spark):
    """10,000 clusters of two rows: per-row silhouettes from the closed form."""
    from pyspark.sql import functions as F
    df = spark.range(20_000).select("id", F.array((F.floor(F.col("id") / 2) * 10 + F.col("id") % 2).cast("double")).alias("x"),
                                    F.floor(F.col("id") / 2).cast("int").alias("cluster"))
    assert quality.cluster_counts(df).collect()[0]["clusters"] == 10_000
    # neighbouring centres 10 apart, mean distance to the centre 0.5: ratio 0.1
    assert abs(quality.davies_bouldin(df, "id").collect()[0][0] - 0.1) < 1e-9
    few = df.where("cluster < 1500")
    got = quality.silhouette(few, "id", block_rows=1024).collect()[0][0]
    # own distance 1, mean distance to the next cluster 9.5 or 10.5 (both 10 +- 0.5), ends have one neighbour
    x = [c * 10 + r for c in range(1500) for r in range(2)]
    want = sum(1 - 1 / min(abs(v - ((v // 10 + s) * 10 + 0.5)) for s in (-1, 1) if 0 <= v // 10 + s < 1500) for v in x) / len(x)
    assert abs(got - want) < 1e-9


def test_rows_alike_in_all_labellings_are_added_up_once(monkeypatch):
    """The block sums of many labellings, with noise, are those of plain distances; one sum a group, not one a labelling."""
    import pyarrow as pa
    from tessera.operators import quality as Q
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 2)) + 1000.0
    labels = np.stack([rng.integers(-1, 2, size=300), np.arange(300) % 3, np.full(300, -1)], axis=1).astype(np.int32)
    sums = []
    monkeypatch.setattr(Q, "TILE_VALUES", 700)

    def batch(ids):
        off = [pa.array(np.arange(0, (len(ids) + 1) * k, k, dtype=np.int32)) for k in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(off[0], pa.array(x[ids].ravel())),
                                           pa.ListArray.from_arrays(off[1], pa.array(labels[ids].ravel()))], ["id", "x", "cs"])
    for order in (np.lexsort(labels.T[::-1]), np.arange(300)):
        block = Q._Silhouette()
        block.add_own(batch(np.arange(100)))
        block.add_partners(batch(order))
        d = np.sqrt(((x[:100, None] - x[None]) ** 2).sum(-1))
        assert set(block.sums) == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)}
        for (g, c), total in block.sums.items():
            assert np.allclose(total, d[:, labels[:, g] == c].sum(axis=1)) and block.sizes[g, c] == (labels[:, g] == c).sum()
        sums.append(len(block.result()))
    assert sums == [2, 2]
