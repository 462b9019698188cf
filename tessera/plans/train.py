"""Training job: preprocess -> fit -> score, with dispatch by algorithm name.

``train`` returns the labels (by key), the fitted state and a one-row
metrics frame. Fitted state: scaler statistics, category lists and KMeans
centres or the table of DBSCAN core points.

The key may be one column of any type or several columns. Clustering itself
runs on a 64-bit number per row: an integer key as it is, any other key
through its rank (so that clusters are numbered in key order), which is
joined back at the end. Tables without a key get one by
:func:`with_row_key`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ref
from tessera.operators import encode, quality
from tessera.operators.keys import numbered

ALGORITHMS = ("KMeans", "DBSCAN", "Agglomerative", "Birch", "MeanShift", "Spectral")


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """``df`` with a number per row in input order. It is checkpointed, so the
    numbers stay the same however often the table is read."""
    from tessera.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.select(F.monotonically_increasing_id().alias(name), *[ref(c) for c in df.columns]).checkpoint(eager=True)


def fit_labels(x_df: DataFrame, key: str, algorithm: str, params: dict) -> DataFrame:
    """``(key, cluster)`` for one algorithm on a frame with ``x``."""
    if algorithm == "KMeans":
        from tessera.operators.kmeans import kmeans
        return kmeans(x_df, key, k=params.get("n_clusters", 3), init=params.get("init", "k-means++"),
                      max_iter=params.get("max_iter", 300))
    if algorithm == "DBSCAN":
        from tessera.operators.dbscan import dbscan
        return dbscan(x_df, key, eps=params.get("eps", 0.5), min_samples=params.get("min_samples", 5))
    if algorithm == "Agglomerative":
        from tessera.operators.agglomerative import agglomerative
        return agglomerative(x_df, key, k=params.get("n_clusters", 3), linkage=params.get("linkage", "ward"))
    if algorithm == "Birch":
        from tessera.operators.birch import birch
        return birch(x_df, key, k=params.get("n_clusters", 3), threshold=params.get("threshold", 0.5), branching=params.get("branching_factor", 50))
    if algorithm == "MeanShift":
        from tessera.operators.meanshift import estimate_bandwidth, mean_shift
        width = params.get("bandwidth") or estimate_bandwidth(x_df, key, params.get("neighbours", 50))
        return mean_shift(x_df, key, width, min_bin=params.get("min_bin_freq", 1))
    if algorithm == "Spectral":
        from tessera.operators.spectral import spectral
        return spectral(x_df, key, k=params.get("n_clusters", 3), neighbours=params.get("n_neighbors", 10), gamma=params.get("gamma"))
    raise ValueError(f"Unknown algorithm: {algorithm}")


@dataclass(frozen=True)
class TrainResult:
    labels: DataFrame
    encoded: encode.Encoded
    metrics: DataFrame
    algorithm: str
    params: dict
    centres: list[list[float]] | None = None   # KMeans
    core: DataFrame | None = None              # DBSCAN: core points with their cluster
    row_key: str | None = None                 # key of ``encoded.frame`` and of ``row_labels``
    row_labels: DataFrame | None = None        # labels by that key (``labels`` has the table's own)


def fit(x_df: DataFrame, key: str, algorithm: str, params: dict):
    """(labels, KMeans centres or None, DBSCAN core points or None)."""
    if algorithm == "KMeans":
        from tessera.operators.kmeans import assign, kmeans_fit
        got = kmeans_fit(x_df, key, params.get("n_clusters", 3), params.get("init", "k-means++"), params.get("max_iter", 300))
        return assign(x_df.select(key, "x"), got.centres).select(key, "cluster"), got.centres, None
    if algorithm == "DBSCAN":
        from tessera.operators.dbscan import core_points
        core = core_points(x_df, key, params.get("eps", 0.5), params.get("min_samples", 5))
        return fit_labels(x_df, key, algorithm, params), None, core
    return fit_labels(x_df, key, algorithm, params), None, None


def train(df: DataFrame, key: str | list[str], algorithm: str, params: dict, scaler: str = "StandardScaler",
          imputer: str = "Mean", min_columns: int = 2, silhouette: str = "exact") -> TrainResult:
    """``silhouette`` is ``exact`` (quadratic), ``squared`` (linear-time, another
    metric) or ``none``: the caller's choice, never made by size."""
    keys = [key] if isinstance(key, str) else list(key)
    feats = [c for c in df.columns if c not in keys]
    if len(feats) < min_columns:
        raise ValueError(f"at least {min_columns} feature columns are needed to cluster")
    frame, rid, mapping = numbered(df, key)
    enc = encode.preprocess(frame, [rid], scaler, imputer)
    x = enc.frame.persist(StorageLevel.MEMORY_AND_DISK)
    labels, centres, core = fit(x, rid, algorithm, params)
    labels = labels.persist(StorageLevel.MEMORY_AND_DISK)
    metrics = quality.all_metrics(x.join(labels, rid), rid, silhouette=silhouette)
    row_labels = labels
    if mapping is not None:
        labels = labels.join(mapping, rid).select(*[ref(k) for k in keys], "cluster")
    return TrainResult(labels, enc, metrics, algorithm, params, centres, core, rid, row_labels)
