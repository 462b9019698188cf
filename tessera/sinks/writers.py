"""Sinks: labelled table, per-cluster statistics, metrics row, the Markdown
report, and fitted models that can score new tables.

Tables are written by the executors (``DataFrame.write``); only the report
(a few dozen lines, bounded by clusters x features) is coalesced into one
file so that it reads in order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import null_if_nan, ref


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_labelled(labelled: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(labelled, path, fmt)


def write_summary(cluster_describe: DataFrame, path: str) -> None:
    write_table(cluster_describe, path, "csv")


def write_metrics(metrics: DataFrame, path: str) -> None:
    write_table(metrics, path, "csv")


def write_report(report: DataFrame, path: str) -> None:
    """``report`` has (section, ordinal, text); written as one ordered text file."""
    (report.orderBy("section", "ordinal").select("text").coalesce(1)
     .write.mode("overwrite").text(path))


# ------------------------------------------------------------------ models

def save_model(spark: SparkSession, path: str, algorithm: str, params: dict, encoded, centres=None,
               core: DataFrame | None = None, core_x: DataFrame | None = None, members: DataFrame | None = None) -> None:
    """Fitted statistics (scaler, imputer, categories), and the model: KMeans
    centres, the DBSCAN core points with their cluster numbers, or for any
    other algorithm its ``members`` (cluster, x). KNN imputation is saved as
    the table of its donors, the training rows."""
    knn = bool(encoded.numeric) and encoded.imputer is None
    meta = {
        "algorithm": algorithm, "params": params,
        "feature_names": encoded.feature_names, "numeric": encoded.numeric,
        "scaler": {"kind": encoded.scaler.kind, "center": encoded.scaler.center, "scale": encoded.scaler.scale},
        "imputer": ({"strategy": encoded.imputer.strategy, "fill": encoded.imputer.fill}
                    if encoded.imputer else None),
        "categories": encoded.categories, "knn": knn,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    if centres is not None:
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cluster int, x array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    if knn:
        from tessera.operators.knn import donor_table
        keys = [c for c in encoded.source.columns if c not in {*encoded.numeric, *encoded.categories}]
        donor_table(encoded.source, keys, encoded.numeric).write.mode("overwrite").parquet(f"{path}/donors")
    if members is not None:
        members.select(F.col("cluster").cast("int").alias("cluster"), "x").write.mode("overwrite").parquet(f"{path}/members")
    if core_x is not None:
        core_x.write.mode("overwrite").parquet(f"{path}/core")


def load_model(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    model = {"meta": meta}
    if meta["algorithm"] == "KMeans":
        rows = spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()
        model["centres"] = [list(r["x"]) for r in rows]
    elif meta["algorithm"] == "DBSCAN":
        model["core"] = spark.read.parquet(f"{path}/core")
    else:
        model["members"] = spark.read.parquet(f"{path}/members")
    if meta.get("knn"):
        model["donors"] = spark.read.parquet(f"{path}/donors")
    return model


def feature_vector(meta: dict) -> Column:
    """The encoded feature vector of a saved model as one expression: imputed
    and scaled numbers, then the one-hot block. NaN is missing, as in training."""
    from tessera.operators.encode import MISSING
    parts = []
    sc, imp = meta["scaler"], meta["imputer"]
    for c in meta["numeric"]:
        x = null_if_nan(ref(c).cast("double"))
        if imp and imp["fill"].get(c) is not None:
            x = F.coalesce(x, F.lit(imp["fill"][c]))
        ctr, s = sc["center"].get(c), sc["scale"].get(c)
        if ctr is None:
            parts.append(x)
        elif s is None:
            parts.append(F.when(x.isNotNull(), F.lit(0.0)))
        else:
            parts.append((x - F.lit(ctr)) / F.lit(s))
    for c, values in meta["categories"].items():
        filled = F.coalesce(ref(c).cast("string"), F.lit(MISSING))
        parts += [F.when(filled == F.lit(v), 1.0).otherwise(0.0) for v in values]
    return F.array(*[p.cast("double") for p in parts])


def encode_with(model: dict, df: DataFrame, key: str) -> DataFrame:
    """Apply saved imputation, scaling and one-hot to a new table -> (key, x)."""
    if model.get("donors") is not None:
        from tessera.operators.knn import knn_impute
        df = knn_impute(df, [key], model["meta"]["numeric"], donors=model["donors"])
    return df.select(key, feature_vector(model["meta"]).alias("x"))


def score(model: dict, df: DataFrame, key: str) -> DataFrame:
    """Labels for new rows: nearest centre (KMeans), the cluster of the nearest
    core point within eps (DBSCAN; otherwise noise), or that of the nearest
    member (any other algorithm; at equal distance the smaller number)."""
    x = encode_with(model, df, key)
    meta = model["meta"]
    if meta["algorithm"] == "KMeans":
        from tessera.operators.kmeans import assign
        return assign(x, model["centres"]).select(key, "cluster")
    if meta["algorithm"] == "DBSCAN":
        from tessera.operators.dbscan import assign_to_core
        return assign_to_core(x, model["core"], key, meta["params"].get("eps", 0.5))
    from tessera.operators.keys import numbered
    from tessera.operators.neighbours import nearest
    points = model["members"].groupBy("x").agg(F.min("cluster").alias("cluster"))
    # ids in the order of the clusters, so that ties go to the smaller number
    number = F.col("cluster").cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("x"), F.lit(1 << 40))
    frame, rid, mapping = numbered(x, key)
    near = nearest(frame.select(F.col(rid).alias("id"), "x"), points.select(number.alias("id"), "x"), 1)
    found = near.select(F.col("id").alias(rid), F.shiftright("nb", 40).cast("int").alias("cluster"))
    return found if mapping is None else found.join(mapping, rid).select(ref(key), "cluster")
