"""Graph helpers on DataFrames: connected components and global ranking.

Connected components contract the graph level by level (see
:func:`connected_components`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, ensure_checkpoint_dir


class NotConverged(RuntimeError):
    pass


LAST_ROUNDS = 0  # rounds used by the latest connected_components call (diagnostics)


def _local_union_find(batches):
    """Components of the edges held by one task (vectorised min-label
    propagation with pointer jumping); yields (v, p) with p the smallest
    vertex of v's local component."""
    srcs, dsts = [], []
    for b in batches:
        srcs.append(b["src"].to_numpy(dtype=np.int64))
        dsts.append(b["dst"].to_numpy(dtype=np.int64))
    if not srcs:
        return
    src, dst = np.concatenate(srcs), np.concatenate(dsts)
    if len(src) == 0:
        return
    verts, inv = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = inv[: len(src)], inv[len(src):]
    lab = np.arange(len(verts))  # indices into the sorted ids: smaller index = smaller id
    while True:
        old = lab.copy()
        np.minimum.at(lab, s, lab[d])
        np.minimum.at(lab, d, lab[s])
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
        if np.array_equal(lab, old):
            break
    yield pd.DataFrame({"v": verts, "p": verts[lab]})


def connected_components(vertices: DataFrame, edges: DataFrame, vid: str = "id",
                         max_edges_per_task: int = 1_000_000, max_levels: int = 64) -> DataFrame:
    """Label every vertex with the smallest vertex id of its component.

    ``vertices`` has column ``vid``; ``edges`` has ``src``/``dst`` (see
    :func:`component_labels`). Returns ``(vid, root)``.
    """
    labels = component_labels(edges, max_edges_per_task, max_levels)
    return (vertices.select(F.col(vid).cast("long").alias(vid))
            .join(labels, F.col(vid) == F.col("v"), "left")
            .select(vid, F.coalesce("root", F.col(vid)).alias("root")))


def component_labels(edges: DataFrame, max_edges_per_task: int = 1_000_000, max_levels: int = 64) -> DataFrame:
    """``(v, root)`` for every vertex that has an edge: the smallest vertex
    id of its component. ``edges`` has ``src``/``dst``; either direction
    suffices, loops and repeated edges are harmless.

    Random-priority contraction: at every level each vertex hooks onto the
    member of its closed neighbourhood with the smallest salted hash, edges
    are rewritten to the hooks, and loops and repeats drop out. A path loses
    about half of its vertices a level and a star collapses at once, so the
    number of levels is logarithmic whatever the shape or the numbering of
    the graph. The hook is a min-aggregate (combined before the shuffle), the
    rewriting two joins. When at most ``max_edges_per_task`` edges are left,
    one task of that bounded size solves the rest in numpy. Every level's
    edges are written to the checkpoint folder, which cuts the plan and is the
    recovery point after a lost executor.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    global LAST_ROUNDS
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    cur = (edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
           .where("src <> dst").checkpoint(eager=True))
    first, maps, scratch = cur, [], Scratch(edges.sparkSession, "components")
    for level in range(1, max_levels + 1):
        LAST_ROUNDS = level
        if cur.count() <= max_edges_per_task:
            break
        order = F.xxhash64(F.col("nb"), F.lit(level))
        hook = (cur.select(F.col("src").alias("v"), F.col("dst").alias("nb"))
                .union(cur.select("dst", "src"))
                .groupBy("v").agg(F.min(F.struct(order.alias("o"), "nb")).alias("m"))
                .select("v", F.when(F.struct(F.xxhash64("v", F.lit(level)).alias("o"), F.col("v").alias("nb")) < F.col("m"),
                                    F.col("v")).otherwise(F.col("m.nb")).alias("p")))
        hook = scratch.keep(hook, f"hook{level}")
        maps.append(hook)
        a = hook.select(F.col("v").alias("src"), F.col("p").alias("a"))
        b = hook.select(F.col("v").alias("dst"), F.col("p").alias("b"))
        cur = (cur.join(a, "src").join(b, "dst")
               .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
               .where("src <> dst").distinct())
        cur = scratch.keep(cur, f"edges{level}")
        if level > 1:
            scratch.drop(f"edges{level - 1}")
    else:
        raise NotConverged(f"connected components did not converge in {max_levels} levels")
    rest = cur.repartition(1).mapInPandas(_local_union_find, "v long, p long")
    if not maps:  # one task has seen all edges: its result is the smallest id already
        return rest.select("v", F.col("p").alias("root"))
    labels = first.select(F.col("src").alias("v")).union(first.select("dst")).distinct().select("v", F.col("v").alias("lab"))
    for m in [*maps, rest]:
        labels = (labels.join(m.select(F.col("v").alias("mv"), "p"), F.col("lab") == F.col("mv"), "left")
                  .select("v", F.coalesce("p", "lab").alias("lab")))
    labels = labels.checkpoint(eager=True)
    scratch.drop()
    smallest = labels.groupBy("lab").agg(F.min("v").alias("root"))
    return labels.join(smallest, "lab").select("v", "root")


def dense_index(df: DataFrame, col: str, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based dense rank of the distinct values of ``col``, without a
    single-partition window.

    Values are range-partitioned, ranked inside each partition, and shifted
    by the running count of the preceding partitions (a list as long as the
    number of partitions is all that reaches the driver).
    """
    distinct = df.select(col).distinct()
    n_parts = partitions or distinct.sparkSession.sparkContext.defaultParallelism
    ranged = (distinct.repartitionByRange(n_parts, col)
              .withColumn("_pid", F.spark_partition_id()))
    # reliable checkpoint: range bounds come from sampling, so a recomputed
    # partition after executor loss must see the same rows as the counts did
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    counts = sorted((r["_pid"], r["n"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for pid, n in counts:
        offsets.append((pid, acc))
        acc += n
    spark = df.sparkSession
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    w = Window.partitionBy("_pid").orderBy(col)
    return (ranged.join(F.broadcast(off_df), "_pid")
            .select(col, (F.row_number().over(w) - 1 + F.col("_off")).alias(out)))
