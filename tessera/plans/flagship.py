"""Flagship job: customer segments.

customer + orders (pre-aggregated per customer) -> standard scaling ->
DBSCAN -> per-cluster size and mean profile. It crosses a source, a join,
an aggregation, scaling, the eps-join, connected components, the label
join and a grouped profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import encode, results
from tessera.operators.dbscan import dbscan
from tessera.sources import tables as T

FEATURES = ["acctbal", "n_orders", "avg_total"]


def customer_segments(spark: SparkSession, sf_dir: str, eps: float = 0.6, min_samples: int = 5) -> DataFrame:
    cf = T.customer_features(spark, sf_dir)
    enc = encode.preprocess(cf, ["c_custkey"], "StandardScaler", "Mean")
    labels = dbscan(enc.frame, "c_custkey", eps, min_samples)
    # the persisted raw features: the orders aggregation is not recomputed
    labelled = results.label_join(enc.source.select("c_custkey", *FEATURES), labels, ["c_custkey"])
    return (labelled.groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("size"),
                 *[F.avg(c).alias(f"mean_{c}") for c in FEATURES])
            .orderBy("cluster"))
