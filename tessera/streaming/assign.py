"""Streaming assignment and cluster-share drift.

A model fitted on a static table (scaler statistics, categories, KMeans
centres) scores a stream statelessly: the encoding and the nearest-centre
rule are plain column expressions, so each micro-batch is a narrow
projection. Drift is the cluster share per event-time window, aggregated
with a watermark so that state for closed windows is dropped and late rows
beyond the watermark are ignored.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import encode
from tessera.operators.kmeans import assign, kmeans_fit
from tessera.session import ensure_checkpoint_dir
from tessera.sinks.writers import feature_vector


def assign_stream(stream: DataFrame, model: dict, key: str, keep: list[str] = ()) -> DataFrame:
    """(key, kept columns..., cluster) for every row of a streaming frame."""
    scored = stream.withColumn("x", feature_vector(model["meta"]))
    return assign(scored, model["centres"]).select(key, *keep, "cluster")


def share_drift(scored: DataFrame, ts: str, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Rows per (event-time window, cluster), with a watermark on ``ts``."""
    # watermarks need TIMESTAMP (session time zone); NTZ columns are converted
    scored = scored.withColumn(ts, F.col(ts).cast("timestamp"))
    return (scored.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), "cluster")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cluster", "n"))


def fit_static_model(df: DataFrame, key: str, k: int = 3, scaler: str = "StandardScaler") -> dict:
    enc = encode.preprocess(df, [key], scaler, "Mean")
    fit = kmeans_fit(enc.frame, key, k=k)
    meta = {"algorithm": "KMeans", "params": {"n_clusters": k}, "feature_names": enc.feature_names,
            "numeric": enc.numeric,
            "scaler": {"kind": enc.scaler.kind, "center": enc.scaler.center, "scale": enc.scaler.scale},
            "imputer": {"strategy": enc.imputer.strategy, "fill": enc.imputer.fill} if enc.imputer else None,
            "categories": enc.categories}
    return {"meta": meta, "centres": fit.centres}


def events_drift(spark: SparkSession, sf_dir: str, k: int = 3, window: str = "1 day",
                 watermark: str | None = None, files_per_trigger: int = 1, model: dict | None = None) -> DataFrame:
    """Replay the events table as a stream, scored by ``model`` (by default a
    KMeans fitted on the static events features), and return the cluster
    counts per window that it produced.

    Update mode: a micro-batch writes the windows it changed as files in the
    shared folder, and nothing is kept in the driver. Counts only grow, so a
    window's last count is its largest. The replay is finite and its files
    come in any order of time, so by default the watermark lies beyond the
    table's time span and no row counts as late; the state is one count per
    window and cluster. A given ``watermark`` drops rows that are later.
    """
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    static = spark.read.parquet(path)
    if model is None:
        model = fit_static_model(static.select("event_id", "event_type", "value"), "event_id", k)
    if watermark is None:
        ts = F.col("ts").cast("timestamp").cast("double")
        span = static.agg(F.max(ts) - F.min(ts)).first()[0]
        watermark = f"{math.ceil(span or 0) + 1} seconds"
    # the file source refuses the plain path of a file; as a pattern, the path
    # may be a file or a directory of part files
    stream = (spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(f"{path[:-1]}[{path[-1]}]"))
    drift = share_drift(assign_stream(stream, model, "event_id", ["ts"]), "ts", window, watermark)
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own files
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    q = (drift.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return (spark.read.schema(drift.schema).parquet(f"{home}/out")
            .groupBy("window_start", "window_end", "cluster").agg(F.max("n").alias("n")))
