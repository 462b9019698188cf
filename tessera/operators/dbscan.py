"""DBSCAN as DataFrame operations (exact).

0. identical points are collapsed into weighted units (they share their
   neighbourhood, core status and label);
1. units fall into cubes with a diagonal below eps: the points of a cube are
   all neighbours of each other, and a cube that holds min_samples rows has
   only core points. The units of thinner cubes count their neighbours, with
   multiplicity, itself included (:func:`tessera.operators.pairs.within`);
2. the core points of a cube belong to one cluster, and cubes are linked by
   two core points within eps: connected components of the cubes. On large
   tables the outermost core points of the cubes link most of them, and all core
   points are then compared only where cubes of different components meet;
3. a non-core point with a core neighbour takes the smallest cluster number
   among its core neighbours (that is the cluster that reaches it first when
   clusters are grown in key order); all others are noise (-1);
4. clusters are numbered 0.. in the order of their smallest core key.

No pair of points is ever written out: what grows with the table is the table
itself, dealt to the cells around each row. Steps 3 and 4 give exactly the labels
of the sequential algorithm that visits points in key order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, sq_dist
from tessera.operators.graph import component_labels, dense_index
from tessera.operators.pairs import _salts, finite, grid_axes, vector_dim, within
from tessera.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class DBSCANResult:
    labels: DataFrame       # (key, cluster)
    core: DataFrame         # (key) of core points, for assigning new rows


REP_ROWS = 200_000  # up to so many core units are linked at once, without a first round on corners


def _units(pts: DataFrame) -> DataFrame:
    """Identical points have identical neighbourhoods: collapse them into one
    weighted unit (smallest key, multiplicity). A partial aggregation, so a
    value repeated by a third of the rows costs one row per task."""
    return pts.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))


def _cell(eps: float, dim: int, largest: float) -> Column:
    """The cube of ``x`` whose diagonal is just below ``eps``, so that all its
    points are neighbours (the margin covers the rounding of the division).
    Rows with a component that is no number are alone in a cell of their own."""
    side = eps / math.sqrt(dim)
    side *= 1 - min(0.5, 1e-9 + 4e-16 * largest / side)
    return (F.when(finite("x"), F.array(*[F.floor(F.col("x")[i] / side) for i in range(dim)]))
            .otherwise(F.array(F.col("id"), *[F.lit(0).cast("long")] * dim)))


def _largest(units: DataFrame, dim: int) -> float:
    size = [F.max(F.abs(F.col("x")[i])).alias(f"m{i}") for i in range(dim)]
    row = collect_row(units.where(finite("x")), *size)
    return max((row[f"m{i}"] or 0.0 for i in range(dim)), default=0.0)


def _linked(core: DataFrame, eps: float, axes: list[int], max_cell_rows: int) -> DataFrame:
    """``core`` (x, c) with the smallest c of those that a chain of core points joins."""
    rows = core.select(F.col("c").alias("id"), "x", F.col("c").alias("v"))
    finite_rows = rows.where(finite("x"))
    roots = component_labels(within(finite_rows, finite_rows.select("x", "v"), eps, axes, "links", max_cell_rows).distinct())
    return roots.select(F.col("v").alias("c"), "root")


def _corners(core: DataFrame, dim: int) -> DataFrame:
    """(x, c): the outermost core points of each c in every coordinate."""
    ends = [f("x", F.col("x")[i]) for i in range(dim) for f in (F.min_by, F.max_by)]
    return core.groupBy("c").agg(F.array_distinct(F.array(*ends)).alias("xs")).select("c", F.explode("xs").alias("x"))


def _labelled(pts: DataFrame, units: DataFrame, eps: float, min_samples: int, key: str, max_cell_rows: int) -> DBSCANResult:
    if eps <= 0:
        raise ValueError("eps must be positive")
    ensure_checkpoint_dir(pts.sparkSession)
    dim = vector_dim(units)
    axes = grid_axes(units.where(finite("x")), dim)
    celled = units.withColumn("cell", _cell(eps, dim, _largest(units, dim)))
    celled = celled.join(celled.groupBy("cell").agg(F.sum("w").alias("cw")), "cell").persist(StorageLevel.MEMORY_AND_DISK)
    # the points of a cell with min_samples rows are core; the others are counted
    thin = celled.where((F.col("cw") < min_samples) & finite("x")).select("id", "x", F.lit(0).alias("v"))
    counts = within(thin, celled.where(finite("x")).select("x", F.col("w").alias("v")), eps, axes, "total", max_cell_rows)
    is_core = (F.col("cw") >= min_samples) | (F.coalesce("n", F.lit(0)) >= min_samples)
    tagged = (celled.join(counts.select("id", F.col("v").alias("n")), "id", "left")
              .select("id", "x", "cell", is_core.alias("core")).checkpoint(eager=True))
    celled.unpersist()
    core = tagged.where("core")
    core = core.join(core.groupBy("cell").agg(F.min("id").alias("c")), "cell").select("id", "x", "c").checkpoint(eager=True)
    # the core points of a cell belong together; cells are linked by core points within eps
    if core.count() > REP_ROWS:
        core = (core.join(_linked(_corners(core, dim), eps, axes, max_cell_rows), "c", "left")
                .select("id", "x", F.coalesce("root", "c").alias("c")).checkpoint(eager=True))
    core = (core.join(_linked(core, eps, axes, max_cell_rows), "c", "left")
            .select("id", "x", F.coalesce("root", "c").alias("root")))
    core_lab = (core.join(dense_index(core, "root", out="cluster"), "root")
                .select("id", "x", F.col("cluster").alias("v")).checkpoint(eager=True))
    border = within(tagged.where(~F.col("core") & finite("x")).select("id", "x", F.lit(0).alias("v")),
                    core_lab.where(finite("x")).select("x", "v"), eps, axes, "least", max_cell_rows)
    unit_lab = (tagged.select("id", "x", "core")
                .join(core_lab.select("id", F.col("v").alias("own")), "id", "left")
                .join(border.select("id", F.col("v").alias("near")), "id", "left")
                .select("x", "core", F.coalesce("own", "near", F.lit(-1)).cast("int").alias("cluster")))
    # back to every row: an equi-join on the feature vector (one unit row per
    # value, so a hot value is a skewed probe side that AQE splits)
    # labels feed many downstream aggregates: cut them from the lineage once
    # (reliable checkpoint, one row per input row)
    labelled = pts.join(unit_lab, "x").select(F.col("id").alias(key), "cluster", "core").checkpoint(eager=True)
    return DBSCANResult(labelled.select(key, "cluster"), labelled.where("core").select(key))


def _unit_rows(df: DataFrame, key: str, x: str) -> tuple[DataFrame, DataFrame]:
    pts = df.select(F.col(key).alias("id"), F.col(x).alias("x"))
    units = _units(pts).withColumn("id", F.col("id").cast("long")).persist(StorageLevel.MEMORY_AND_DISK)
    return pts, units


def dbscan_fit(df: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5,
               x: str = "x", max_cell_rows: int = 20000) -> DBSCANResult:
    pts, units = _unit_rows(df, key, x)
    found = _labelled(pts, units, eps, min_samples, key, max_cell_rows)
    units.unpersist()  # the labels are checkpointed
    return found


def dbscan_multi(df: DataFrame, key: str, eps_list: list[float], min_samples: int = 5, x: str = "x",
                 max_cell_rows: int = 20000) -> DataFrame:
    """(eps, key, cluster) for several eps values on one table of units."""
    pts, units = _unit_rows(df, key, x)
    out = None
    for eps in eps_list:
        lab = _labelled(pts, units, eps, min_samples, key, max_cell_rows).labels
        lab = lab.select(F.lit(float(eps)).alias("eps"), key, "cluster")
        out = lab if out is None else out.unionByName(lab)
    units.unpersist()
    return out


def dbscan(df: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5, x: str = "x",
           max_cell_rows: int = 20000) -> DataFrame:
    """``(key, cluster)`` with -1 for noise."""
    return dbscan_fit(df, key, eps, min_samples, x, max_cell_rows).labels


def neighbour_counts(df: DataFrame, key: str, eps: float, x: str = "x",
                     max_cell_rows: int = 20000) -> DataFrame:
    """``(key, n_neighbors)``: points within eps, the point itself included.
    Counted in tiles inside the tasks; no pair is written out."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    pts = df.select(F.col(key).alias("id"), F.col(x).alias("x"))
    units = _units(pts).persist(StorageLevel.MEMORY_AND_DISK)
    dim = vector_dim(units)
    rows = units.where(finite("x")).select("id", "x", F.col("w").alias("v"))
    found = within(rows, rows.select("x", "v"), eps, grid_axes(rows, dim), "total", max_cell_rows)
    deg = units.join(found, "id", "left").select("x", F.coalesce("v", "w").alias("n"))
    return pts.join(deg, "x").select(F.col("id").alias(key), F.col("n").cast("bigint").alias("n_neighbors"))


def core_points(df: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5, x: str = "x") -> DataFrame:
    """(key, x, cluster) of the core points: what a saved DBSCAN model keeps."""
    res = dbscan_fit(df, key, eps, min_samples, x)
    return (df.select(key, x).join(res.core, key, "left_semi")
            .join(res.labels, key).select(key, F.col(x).alias("x"), "cluster"))


def assign_to_core(new: DataFrame, core: DataFrame, key: str, eps: float, x: str = "x",
                   max_cell_rows: int = 20000) -> DataFrame:
    """New rows take the cluster of their nearest core point within eps
    (ties to the lower cluster number); rows with no core point within eps
    are noise. The same grid as the eps-join, on the two coordinates along
    which the core points vary most, between two tables; crowded cells are
    salted alike."""
    dim = vector_dim(new, x)
    axes = grid_axes(core, dim)

    def cells(df, c):
        return [F.floor(F.col(c)[axes[0]] / eps).alias("cx"),
                (F.floor(F.col(c)[axes[1]] / eps) if len(axes) > 1 else F.lit(0).cast("long")).alias("cy")]

    probe = new.select(F.col(key).alias("nid"), F.col(x).alias("nx"), *cells(new, x))
    salted = _salts(probe, max_cell_rows)
    offs = [(dx, dy) for dx in (-1, 0, 1) for dy in ((-1, 0, 1) if len(axes) > 1 else (0,))]
    near_cells = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in offs]))
    build = (core.select(F.col("x").alias("kx"), F.col("cluster").alias("kc"), *cells(core, "x"))
             .select("kx", "kc", near_cells.alias("c")).select("kx", "kc", "c.cx", "c.cy"))
    build = salted(build).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    probe = salted(probe).withColumn("salt", F.pmod(F.xxhash64("nid"), F.col("salts")).cast("int")).drop("salts")
    near = (probe.join(build, ["cx", "cy", "salt"])
            .withColumn("d2", sq_dist("nx", "kx", dim))
            .where(F.col("d2") <= eps * eps)
            .groupBy("nid").agg(F.min(F.struct("d2", "kc")).alias("b")))
    return (new.select(F.col(key).alias("nid")).join(near, "nid", "left")
            .select(F.col("nid").alias(key), F.coalesce(F.col("b.kc"), F.lit(-1)).cast("int").alias("cluster")))
