"""Cluster results: label join, sizes, shares, mean profiles, importance,
heatmap and radar series, pair-scatter columns, per-cluster describe and
text descriptions.

Everything is a group-by over the labelled table (one row per cluster) or
a long-form projection of that small result; noise is the group -1. The
only driver round trip is the one-row overall mean used by descriptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, numeric_cols, ref

# The texts of the descriptions (this one, and "near-average across all features" below).
NOISE_TEXT = "Outlier points not assigned to any cluster by DBSCAN."


def label_join(df: DataFrame, labels: DataFrame, key_cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Attach labels by key (rows are matched by identity, not by position)."""
    return df.join(labels.select(*[ref(k) for k in key_cols], ref(cluster)), key_cols, "inner")


def _features(df: DataFrame, key_cols: list[str], cluster: str, features: list[str] | None) -> list[str]:
    return features or numeric_cols(df, exclude=[*key_cols, cluster])


def cluster_sizes(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("count"))


def cluster_share(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    # one row per cluster, so the unpartitioned window is over a bounded table
    sizes = cluster_sizes(labelled, cluster)
    return sizes.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def cluster_profile(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                    features: list[str] | None = None) -> DataFrame:
    """Mean of every numeric feature per cluster (missing ignored), wide form."""
    feats = _features(labelled, key_cols, cluster, features)
    return labelled.groupBy(cluster).agg(*[F.avg(ref(c).cast("double")).alias(c) for c in feats])


def profile_long(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                 features: list[str] | None = None) -> DataFrame:
    """(cluster, feature, mean): the radar series."""
    feats = _features(labelled, key_cols, cluster, features)
    wide = cluster_profile(labelled, key_cols, cluster, feats)
    structs = [F.struct(F.lit(c).alias("feature"), ref(c).alias("mean")) for c in feats]
    return wide.select(cluster, F.explode(F.array(*structs)).alias("r")).select(cluster, "r.feature", "r.mean")


def feature_importance(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                       features: list[str] | None = None, top: int = 10) -> DataFrame:
    """Spread (max - min) of the cluster means per feature, largest first."""
    long = profile_long(labelled, key_cols, cluster, features)
    return (long.groupBy("feature").agg((F.max("mean") - F.min("mean")).alias("spread"))
            .orderBy(F.desc("spread"), F.asc("feature")).limit(top))


def cluster_heatmap(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                    features: list[str] | None = None) -> DataFrame:
    """Cluster means scaled per feature: (m - min) / (max - min + 1e-9); no
    rows for a single feature, which has nothing to compare."""
    if len(_features(labelled, key_cols, cluster, features)) < 2:
        labelled = labelled.limit(0)
    long = profile_long(labelled, key_cols, cluster, features)
    w = Window.partitionBy("feature")
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    return long.select(cluster, "feature", ((F.col("mean") - lo) / (hi - lo + F.lit(1e-9))).alias("norm"))


def pair_scatter(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                 features: list[str] | None = None, top: int = 4) -> DataFrame:
    """Key, the top features by spread, and the label; no rows for a single feature."""
    if len(_features(labelled, key_cols, cluster, features)) < 2:
        labelled = labelled.limit(0)
    best = [r["feature"] for r in feature_importance(labelled, key_cols, cluster, features, top).collect()]
    return labelled.select(*[ref(c) for c in [*key_cols, *best, cluster]])


def cluster_describe(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                     features: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per (cluster, feature)."""
    from tessera.functions.quantiles import grouped_quantiles
    feats = _features(labelled, key_cols, cluster, features)
    qs = grouped_quantiles(labelled, cluster, feats, [0.25, 0.5, 0.75])
    agg = labelled.groupBy(cluster).agg(*[F.struct(
        F.count(ref(c)).alias("count"),
        F.avg(ref(c).cast("double")).alias("mean"),
        F.stddev_samp(ref(c).cast("double")).alias("std"),
        F.min(ref(c).cast("double")).alias("min"),
        F.max(ref(c).cast("double")).alias("max")).alias(f"c{i}") for i, c in enumerate(feats)])
    # quartiles per (cluster, feature): one row per cluster, so a literal map is bounded
    qmap = F.create_map(*[x for (g, c), q in qs.items() if q is not None
                          for x in (F.lit(f"{g}|{c}"), F.array(*[F.lit(float(v)) for v in q]))])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}.count").alias("count"),
                        F.col(f"c{i}.mean").alias("mean"), F.col(f"c{i}.std").alias("std"),
                        F.col(f"c{i}.min").alias("min"),
                        qmap[F.concat_ws("|", F.col(cluster).cast("string"), F.lit(c))][0].alias("q25"),
                        qmap[F.concat_ws("|", F.col(cluster).cast("string"), F.lit(c))][1].alias("q50"),
                        qmap[F.concat_ws("|", F.col(cluster).cast("string"), F.lit(c))][2].alias("q75"),
                        F.col(f"c{i}.max").alias("max")) for i, c in enumerate(feats)]
    return agg.select(cluster, F.explode(F.array(*structs)).alias("r")).select(cluster, "r.*")


def cluster_descriptions(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster",
                         features: list[str] | None = None) -> DataFrame:
    """Per cluster: size, share and a sentence naming up to three features whose
    mean is above 1.1x / below 0.9x the overall mean (in column order).

    The factor is applied to the signed overall mean, so for a negative mean
    the meaning of above and below flips; that is kept on purpose.
    """
    feats = _features(labelled, key_cols, cluster, features)
    overall = collect_row(labelled, *[F.avg(ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(feats)])
    prof = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                         *[F.avg(ref(c).cast("double")).alias(f"f{i}") for i, c in enumerate(feats)])
    above = F.filter(F.array(*[F.when(F.col(f"f{i}") > F.lit(overall[f"m{i}"]) * 1.1, F.lit(c))
                               for i, c in enumerate(feats)]), lambda v: v.isNotNull())
    below = F.filter(F.array(*[F.when(F.col(f"f{i}") < F.lit(overall[f"m{i}"]) * 0.9, F.lit(c))
                               for i, c in enumerate(feats)]), lambda v: v.isNotNull())
    parts = F.filter(F.array(
        F.when(F.size(above) > 0, F.concat(F.lit("above-average "), F.array_join(F.slice(above, 1, 3), ", "))),
        F.when(F.size(below) > 0, F.concat(F.lit("below-average "), F.array_join(F.slice(below, 1, 3), ", ")))),
        lambda v: v.isNotNull())
    desc = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("near-average across all features"))
    total = F.sum("n").over(Window.partitionBy())  # one row per cluster
    return prof.select(
        F.col(cluster), F.col("n"), (F.col("n") * 100.0 / total).alias("pct"),
        F.when(F.col(cluster) == -1, F.lit(NOISE_TEXT)).otherwise(desc).alias("description"))


def cluster_map(x_df: DataFrame, labels: DataFrame, key_cols: list[str], dim: int,
                hover: DataFrame | None = None) -> DataFrame:
    """Points of the cluster map: centred 2-D PCA projection of ``x`` with the
    label (and optional hover columns), joined by key."""
    from tessera.operators.features import pca_project_2d
    pts = pca_project_2d(x_df, key_cols, dim).join(labels.select(*[ref(k) for k in key_cols], "cluster"), key_cols)
    return pts.join(hover, key_cols, "left") if hover is not None else pts


def comparison_series(ranked: DataFrame) -> DataFrame:
    """Bar series of the search comparison: label = algorithm + config."""
    return ranked.select("ordinal", F.concat_ws(" ", "algorithm", "config").alias("label"),
                         "silhouette", "davies_bouldin", "clusters")
