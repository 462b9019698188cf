import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5  # noise + 4 clusters at eps 0.6
    assert df.columns == ["cluster", "size", "mean_acctbal", "mean_n_orders", "mean_avg_total"]
    assert sorted((r["cluster"], r["size"]) for r in rows) == [(-1, 63), (0, 54), (1, 19), (2, 9), (3, 5)]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
