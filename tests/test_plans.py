"""Plan properties: pruning, pushdown, no cartesian products."""

from tessera.operators import clean, encode
from tessera.operators.dbscan import dbscan
from tessera.sources import tables as T

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_derived_input_reads_only_needed_columns(spark):
    plan = _plan(T.customer_features(spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    # orders are aggregated per customer before the exchange (partial aggregation)
    assert plan.count("HashAggregate") >= 2


def test_outlier_filter_pushes_ranges_to_parquet(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")  # untruncated PushedFilters
    df = clean.iqr_filter(T.line_num(spark, SF), exclude=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    plan = _plan(df)
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity" in pushed and "LessThanOrEqual(l_tax" in pushed


def test_no_cartesian_product_in_clustering(spark):
    enc = encode.preprocess(T.customer_features(spark, SF), ["c_custkey"])
    plan = _plan(dbscan(enc.frame, "c_custkey", 0.6, 5))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
