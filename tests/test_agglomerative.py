import numpy as np

from tessera.operators.agglomerative import agglomerative, dendrogram, lance_williams, single_linkage_at


def greedy(X, link, k):
    clusters = {i: [i] for i in range(len(X))}

    def dist(a, b):
        A, B = X[clusters[a]], X[clusters[b]]
        D = np.sqrt(((A[:, None] - B[None]) ** 2).sum(-1))
        if link == "single":
            return D.min()
        if link == "complete":
            return D.max()
        if link == "average":
            return D.mean()
        na, nb = len(A), len(B)
        return np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(A.mean(0) - B.mean(0))

    while len(clusters) > k:
        keys = sorted(clusters)
        best = min((dist(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1:])
        clusters[best[1]] += clusters.pop(best[2])
    lab = np.zeros(len(X), dtype=int)
    for c, members in clusters.items():
        lab[members] = c
    return lab


def canon(lab):
    seen = {}
    return [seen.setdefault(v, len(seen)) for v in lab]


def _frame(spark, X):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(X)], "k long, x array<double>")


def test_lance_williams_equals_greedy():
    rng = np.random.default_rng(7)
    for _ in range(5):
        X = rng.normal(size=(25, 3))
        for link in ("ward", "complete", "average"):
            d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
            np.fill_diagonal(d, np.inf)
            merges = lance_williams(d, np.ones(len(X)), link)
            lab = np.arange(len(X))
            for a, b, _ in merges[: len(X) - 4]:
                lab[lab == b] = a
            assert canon(lab) == canon(greedy(X, link, 4))


def test_spark_labels_equal_greedy(spark):
    X = np.random.default_rng(8).normal(size=(50, 2))
    df = _frame(spark, X)
    for link in ("ward", "complete", "average", "single"):
        got = [r["cluster"] for r in agglomerative(df, "k", 4, link).orderBy("k").collect()]
        assert canon(got) == canon(greedy(X, link, 4))
        assert got[0] == 0  # canonical numbering: cluster of the smallest key is 0
    d = dendrogram(df, "k", "ward").orderBy("step").collect()
    assert len(d) == 49 and [r["height"] for r in d] == sorted(r["height"] for r in d) and d[-1]["size"] == 50


def test_rounds_give_the_tree_of_one_task(spark):
    """Reciprocal-neighbour rounds over many blocks and one bounded task agree."""
    X = np.random.default_rng(9).normal(size=(3000, 2))
    df = _frame(spark, X).cache()
    one = [r["cluster"] for r in agglomerative(df, "k", 5, "ward", finish=3000).orderBy("k").collect()]
    many = [r["cluster"] for r in agglomerative(df, "k", 5, "ward", finish=400, block=700).orderBy("k").collect()]
    assert one == many
    small = _frame(spark, X[:300]).cache()
    for link in ("complete", "average"):
        one = [r["cluster"] for r in agglomerative(small, "k", 5, link).orderBy("k").collect()]
        many = [r["cluster"] for r in agglomerative(small, "k", 5, link, finish=60, block=90).orderBy("k").collect()]
        assert one == many


def test_single_linkage_at_height_is_threshold_graph(spark):
    X = np.array([[0.0], [0.4], [0.8], [5.0], [5.3], [9.0]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(X)], "k long, x array<double>")
    got = [r["cluster"] for r in single_linkage_at(df, "k", 0.45).orderBy("k").collect()]
    assert got == [0, 0, 0, 1, 1, 2]


def test_clusters_larger_than_a_block(spark):
    """Two dense groups outgrow their block: their rows are dealt over all blocks, with the same tree."""
    rng = np.random.default_rng(12)
    X = np.concatenate([rng.normal(size=(26, 2)) * 0.5, rng.normal(size=(22, 2)) * 0.5 + [6, 1], rng.normal(size=(6, 2)) * 4 + [0, 30]])
    df = _frame(spark, X).cache()
    for link in ("complete", "average"):
        one = [r["cluster"] for r in agglomerative(df, "k", 4, link).orderBy("k").collect()]
        many = [r["cluster"] for r in agglomerative(df, "k", 4, link, finish=4, block=18).orderBy("k").collect()]
        assert one == many


def test_repeated_vectors_and_many_rounds(spark):
    """Equal rows merge first, by key; rounds of joins leave the optimizer's size estimate small."""
    from tessera.operators.agglomerative import cut, merge_table
    rng = np.random.default_rng(13)
    X = np.repeat(rng.normal(size=(10, 2)), 3, axis=0)[rng.permutation(30)]
    df = _frame(spark, X).cache()
    for link in ("ward", "average"):
        tree = merge_table(df, "k", link, finish=3, block=8)
        assert tree._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
        got = {(r["left"], r["right"], r["size"]) for r in tree.where("height = 0").collect()}
        groups = [np.flatnonzero((X == v).all(axis=1)).tolist() for v in np.unique(X, axis=0)]
        assert got == {(g[0], k, n) for g in groups for n, k in enumerate(g[1:], 2)} and tree.count() == 29
        labels = [r["cluster"] for r in cut(df, "k", tree, 4).orderBy("k").collect()]
        assert canon(labels) == canon(greedy(X, link, 4))


def test_boxes_decide_most_merges(spark, monkeypatch):
    """Merges decided within boxes are those of the whole matrix, and few rounds compare all rows with all rows."""
    from tessera.operators import agglomerative as A
    from tessera.operators.merge_boxes import Box
    rng = np.random.default_rng(14)
    for link in ("ward", "complete", "average"):
        X, w = rng.normal(size=(300, 3)), rng.integers(1, 4, size=300)
        box = Box(np.arange(300), w, X, link, 40)
        box.run(np.full(3, -np.inf), np.full(3, np.inf))
        d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) * (np.sqrt(2 * w[:, None] * w[None] / (w[:, None] + w[None])) if link == "ward" else 1)
        np.fill_diagonal(d, np.inf)
        want = {(a, b): h for a, b, h in lance_williams(d, w.astype(float), link)}
        assert len(box.merges) > 30 and all(abs(want[a, b] - h) < 1e-9 for a, b, h, _ in box.merges)
    calls, real = [], A._nearest
    monkeypatch.setattr(A, "_nearest", lambda *a: calls.append(1) or real(*a))
    df = _frame(spark, rng.normal(size=(900, 2))).cache()
    many = A.merge_table(df, "k", "average", finish=80, block=100)
    assert not calls
    one = A.merge_table(df, "k", "average", finish=900)
    assert {(r["left"], r["right"], r["size"], round(r["height"], 9)) for r in many.collect()} == {(r["left"], r["right"], r["size"], round(r["height"], 9)) for r in one.collect()}
