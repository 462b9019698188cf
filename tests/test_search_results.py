import tempfile
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import results
from tessera.plans import search


def test_grid_sizes():
    assert len(search.config_grid(8)) == 24
    assert len(search.config_grid(12)) == 28


def test_rank_ties_by_grid_order(spark):
    scores = spark.createDataFrame([(0, "A", "{}", 0.5, 1.0, 2), (1, "B", "{}", 0.7, 1.0, 2),
                                    (2, "C", "{}", 0.5, 1.0, 3), (3, "D", "{}", -1.0, 999.0, 2)],
                                   "ordinal int, algorithm string, config string, silhouette double, "
                                   "davies_bouldin double, clusters bigint")
    assert [r["ordinal"] for r in search.rank(scores).collect()] == [1, 0, 2, 3]


def test_deterministic_sample_is_partition_independent(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = sorted(r["k"] for r in search.deterministic_sample(df, "k", 100).collect())
    b = sorted(r["k"] for r in search.deterministic_sample(df.repartition(7), "k", 100).collect())
    assert a == b and len(a) == 100


def test_descriptions_with_negative_mean(spark):
    # overall mean of v is negative: 1.1 x mean is lower than the mean, so a
    # cluster slightly above average is still reported as "above-average"
    rows = [(1, -10.0, 0), (2, -10.0, 0), (3, -1.0, 1), (4, -1.0, 1), (5, 0.0, -1)]
    df = spark.createDataFrame(rows, "k int, v double, cluster int")
    got = {r["cluster"]: r["description"] for r in results.cluster_descriptions(df, ["k"]).collect()}
    assert got[1] == "above-average v"
    assert got[0] == "below-average v"
    assert got[-1] == results.NOISE_TEXT


def test_train_validation(spark):
    import pytest
    from tessera.plans.train import fit_labels, train
    one = spark.createDataFrame([(i, float(i)) for i in range(20)], "k long, a double")
    with pytest.raises(ValueError):
        train(one, "k", "KMeans", {"n_clusters": 2})
    with pytest.raises(ValueError):
        fit_labels(one, "k", "OPTICS", {})  # not an algorithm of this library


def test_search_skips_what_cannot_be_fitted_and_scores_the_refit(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 9 + i * 0.01, 1.0]) for i in range(4)], "k long, x array<double>")
    res = search.run_search(df, "k")
    assert res.ranked.agg(F.max("clusters")).collect()[0][0] < 4 and res.labels.count() == 4
    assert res.metrics.collect()[0]["silhouette"] > 0.9


def test_comparison_takes_all_rows(spark, monkeypatch):
    from tessera.plans import catalog
    rows = []
    x = spark.range(5200).select(F.col("id").alias("user_id"), F.array((F.col("id") % 2).cast("double") * 9).alias("x"))

    def counted(x_df, key, configs):
        rows.append(x_df.count())
        return spark.createDataFrame([(0, "KMeans", "{}", 0.5, 1.0, 2)], search.SCORES)
    monkeypatch.setattr(catalog, "_uf_x", lambda *_: x)
    monkeypatch.setattr(search, "evaluate", counted)
    assert catalog.queries()["automl_comparison"](spark, "").count() == 1 and rows == [5200]


def test_any_key_gives_the_labels_of_the_integer_key(spark):
    from tessera.plans.train import train, with_row_key
    from tessera.sources import tables as T
    cf = T.customer_features(spark, "/root/testdata/sf0.001")
    want = {r["c_custkey"]: r["cluster"] for r in train(cf, "c_custkey", "DBSCAN", {"eps": 0.6}).labels.collect()}
    text = cf.withColumn("c_custkey", F.format_string("c%06d", "c_custkey"))
    got = {int(r["c_custkey"][1:]): r["cluster"] for r in train(text, "c_custkey", "DBSCAN", {"eps": 0.6}).labels.collect()}
    assert got == want
    two = cf.withColumn("a", F.floor(F.col("c_custkey") / 10)).withColumn("b", F.col("c_custkey") % 10).drop("c_custkey")
    got = {r["a"] * 10 + r["b"]: r["cluster"] for r in train(two, ["a", "b"], "DBSCAN", {"eps": 0.6}).labels.collect()}
    assert got == want
    bare = with_row_key(cf.drop("c_custkey"))
    got = Counter(r["cluster"] for r in train(bare, "row_key", "DBSCAN", {"eps": 0.6}).labels.collect())
    sizes = Counter(want.values())
    assert got[-1] == sizes[-1] and sorted(got.values()) == sorted(sizes.values())  # numbered in row order


def test_trained_model_scores_its_rows(spark):
    import tempfile
    import pytest
    from tessera.plans.train import train
    from tessera.sinks import writers
    from tessera.sources import tables as T
    cf = T.customer_features(spark, "/root/testdata/sf0.001").withColumn(
        "acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("acctbal")).otherwise(F.lit(float("nan"))))
    for imputer in ("Mean", "Median"):
        res = train(cf, "c_custkey", "KMeans", {"n_clusters": 3}, imputer=imputer, silhouette="none")
        path = tempfile.mkdtemp(prefix="tessera-model-", dir="/tmp") + "/m"
        writers.save_model(spark, path, "KMeans", res.params, res.encoded, centres=res.centres)
        scored = writers.score(writers.load_model(spark, path), cf, "c_custkey")
        assert {tuple(r) for r in scored.collect()} == {tuple(r) for r in res.labels.collect()}
    knn = train(cf, "c_custkey", "KMeans", {"n_clusters": 3}, imputer="KNN", silhouette="none")
    path = tempfile.mkdtemp(prefix="tessera-model-", dir="/tmp") + "/m"
    writers.save_model(spark, path, "KMeans", knn.params, knn.encoded, centres=knn.centres)
    scored = writers.score(writers.load_model(spark, path), cf, "c_custkey")
    assert {tuple(r) for r in scored.collect()} == {tuple(r) for r in knn.labels.collect()}


def test_any_labelling_scores_new_rows(spark):
    """Agglomerative labels, KNN imputation and a string key: training rows get their labels back."""
    from tessera.plans.train import train
    from tessera.sinks import writers
    rows = [(f"r{i:02d}", 9.0 * (i % 3) + i / 100 if i % 7 else None, 3.0 * (i % 3) + i / 50) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    res = train(df, "k", "Agglomerative", {"n_clusters": 3, "linkage": "average"}, imputer="KNN", silhouette="none")
    members = res.encoded.frame.join(res.row_labels, res.row_key)
    path = tempfile.mkdtemp(prefix="tessera-model-", dir="/tmp") + "/m"
    writers.save_model(spark, path, "Agglomerative", res.params, res.encoded, members=members)
    model = writers.load_model(spark, path)
    assert {tuple(r) for r in writers.score(model, df, "k").collect()} == {tuple(r) for r in res.labels.collect()}
    new = spark.createDataFrame([("x", 9.2, 3.1), ("y", None, 6.0)], "k string, a double, b double")
    label = {r["k"]: r["cluster"] for r in res.labels.collect()}
    assert {tuple(r) for r in writers.score(model, new, "k").collect()} == {("x", label["r01"]), ("y", label["r02"])}
