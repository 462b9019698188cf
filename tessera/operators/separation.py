"""Dunn index: the smallest distance between two clusters over the largest
diameter of one, without comparing all rows.

With centroids and radii (largest distance of a row to its centroid) the
triangle inequality rules out most rows. Two rows of a cluster are at most the
sum of their distances to the centroid apart: once some pair is known, only
rows that could beat it stay. A row of cluster a can be within a known gap of
cluster b only if it is within that gap plus b's radius of b's centroid. What
is left is compared block by block; a task returns one number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import sq_dist
from tessera.operators.pairs import vector_dim
from tessera.session import ensure_checkpoint_dir

BLOCK_ROWS = 2048


def _extreme(left: DataFrame, right: DataFrame, keys: list[str], largest: bool, block_rows: int) -> DataFrame:
    """``keys``, ``d2``: the largest or smallest squared distance between rows
    of ``left`` and ``right`` (columns keys, id, x) with the same keys."""
    def blocked(df, mine, other):
        n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias(f"n{mine}"))
        return df, n
    left, nl = blocked(left, "l", "r")
    right, nr = blocked(right, "r", "l")
    counts = nl.join(nr, keys).checkpoint(eager=True)  # a row a pair of clusters
    lx = (left.join(F.broadcast(counts), keys).withColumn("_l", F.pmod(F.xxhash64("id"), F.col("nl")).cast("int"))
          .withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).select(*[F.col(c).alias(c) for c in (*keys, "_l", "_r", "x")]))
    rx = (right.join(F.broadcast(counts), keys).withColumn("_r", F.pmod(F.xxhash64("id"), F.col("nr")).cast("int"))
          .withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).select(*[F.col(c).alias(c) for c in (*keys, "_l", "_r", "x")]))  # names of its own: both sides may be one table

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({**{k: [] for k in keys}, "d2": []})
        p, q = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        best = -math.inf if largest else math.inf
        step = max(1, (1 << 22) // len(q))
        for lo in range(0, len(p), step):
            d2 = np.zeros((len(p[lo: lo + step]), len(q)))
            for i in range(p.shape[1]):
                d2 += (p[lo: lo + step, i, None] - q[None, :, i]) ** 2
            best = max(best, d2.max()) if largest else min(best, d2.min())
        return pd.DataFrame({**{k: [a[k].iloc[0]] for k in keys}, "d2": [best]})

    on = [*keys, "_l", "_r"]
    schema = ", ".join(f"{k} int" for k in keys) + ", d2 double"
    part = lx.groupBy(*on).cogroup(rx.groupBy(*on)).applyInPandas(run, schema)
    return part.groupBy(*keys).agg((F.max if largest else F.min)("d2").alias("d2"))


def dunn(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: ``min_separation``, ``max_diameter`` and ``dunn``; noise (-1)
    is left out. All null with fewer than two clusters, the index null if every
    cluster is a single point."""
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    out = "min_separation double, max_diameter double, dunn double"
    rows = df.where(F.col(cluster) >= 0).select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(cluster).cast("int").alias("c"))
    if rows.select("c").distinct().count() < 2:
        return spark.createDataFrame([(None, None, None)], out)
    dim = vector_dim(rows)
    mean = F.array(*[F.avg(F.col("x")[i]) for i in range(dim)])
    centres = rows.groupBy("c").agg(mean.alias("m"))
    rows = rows.join(F.broadcast(centres), "c").withColumn("r", F.sqrt(sq_dist("x", "m", dim))).checkpoint(eager=True)
    # a first pair of each cluster: its farthest row from the centroid, and the farthest row from that one
    balls = rows.groupBy("c").agg(F.max("r").alias("radius"), F.max_by("x", "r").alias("far"), F.first("m").alias("m")).checkpoint(eager=True)
    sweep = rows.join(F.broadcast(balls.select("c", "far", "radius")), "c").withColumn("f", F.sqrt(sq_dist("x", "far", dim)))
    known = sweep.groupBy("c").agg(F.max("f").alias("least"), F.first("radius").alias("radius")).checkpoint(eager=True)
    floor = known.agg(F.max("least")).first()[0]  # the largest diameter is at least this
    slack = 1 - 1e-9  # against rounding of the bounds
    near_edge = rows.join(F.broadcast(known), "c").where(F.col("r") + F.col("radius") >= F.lit(floor * slack)).select("c", "id", "x")
    wide = _extreme(near_edge, near_edge, ["c"], True, block_rows).agg(F.max("d2")).first()[0]
    diameter = math.sqrt(max(wide if wide is not None else 0.0, floor * floor))
    # a first gap: for each two clusters the row of one closest to the other's centroid, and the row of the other closest to it
    others = F.array(*[F.struct(F.lit(b["c"]).alias("o"), F.array(*[F.lit(v) for v in b["m"]]).alias("om"), F.lit(b["radius"]).alias("oradius"))
                       for b in balls.collect()])  # a value a cluster
    facing = (rows.select("c", "id", "x", F.explode(others).alias("_o")).select("c", "id", "x", "_o.*").where("c <> o")
              .withColumn("t", F.sqrt(sq_dist("x", "om", dim))))  # clusters, not rows, a row
    front = facing.groupBy("c", "o").agg(F.min_by("x", "t").alias("p")).select(F.col("c").alias("o"), F.col("o").alias("c"), "p")
    gap = rows.join(F.broadcast(front), "c").agg(F.min(sq_dist("x", "p", dim))).first()[0]
    gap = math.sqrt(gap)
    close = facing.where(F.col("t") - F.col("oradius") <= F.lit(gap / slack + 1e-300)).select(
        F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "id", "x")
    least = _extreme(close.where("c = a").drop("c"), close.where("c = b").drop("c"), ["a", "b"], False, block_rows).agg(F.min("d2")).first()[0]
    gap = min(gap, math.sqrt(least)) if least is not None else gap
    return spark.createDataFrame([(gap, diameter, gap / diameter if diameter > 0 else None)], out)
