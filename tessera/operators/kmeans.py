"""KMeans: Spark ML fit, nearest-centre assignment, one Lloyd step, inertia,
and the elbow sweep.

Centres are model state (k x d, bounded by ``k``). Assignment needs neither
a join nor a broadcast: small models inline the centres as literals in one
codegen'd expression per row, larger ones ship them inside an Arrow-batched
pandas UDF (arg-min, ties to the lowest index). Cluster numbers are made canonical: ordered by the smallest key
of each cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairs import vector_dim

MAX_CENTRE_VALUES = 1_000_000  # k * d literals inlined into the assignment expression


@dataclass(frozen=True)
class KMeansFit:
    centres: list[list[float]]  # canonical order
    inertia: float
    iterations: int


def _dist2_to(x: str, centre: list[float]) -> Column:
    e = None
    for i, v in enumerate(centre):
        t = (F.col(x)[i] - F.lit(float(v))) * (F.col(x)[i] - F.lit(float(v)))
        e = t if e is None else e + t
    return e


CHUNK_VALUES = 1 << 22  # differences held at once
EXPR_MAX_VALUES = 64  # up to k * d literals the assignment stays one codegen'd expression


def _nearest_udf(centres: list[list[float]]):
    """Arrow-batched nearest centre: (cluster, squared distance) per row."""
    from pyspark.sql.functions import pandas_udf

    C = np.asarray(centres, dtype=np.float64)
    step = max(1, CHUNK_VALUES // max(1, C.size))

    @pandas_udf("struct<i:int,d:double>")
    def nearest(xs: pd.Series) -> pd.DataFrame:
        X = np.stack(xs.to_numpy()).astype(np.float64) if len(xs) else np.empty((0, C.shape[1]))
        at, best = [np.empty(0, np.int64)], [np.empty(0)]
        for lo in range(0, len(X), step):  # the differences of a few rows to all centres at a time
            d2 = ((X[lo:lo + step, None, :] - C[None, :, :]) ** 2).sum(-1)
            i = np.argmin(d2, axis=1)  # first minimum: ties go to the lowest index
            at.append(i)
            best.append(d2[np.arange(len(i)), i])
        return pd.DataFrame({"i": np.concatenate(at).astype("int32"), "d": np.concatenate(best)})

    return nearest


def _nearest(x: str, centres: list[list[float]]) -> Column:
    k, d = len(centres), len(centres[0]) if centres else 0
    if k * d > MAX_CENTRE_VALUES:
        raise ValueError(f"{k} centres x {d} dims is above {MAX_CENTRE_VALUES} values")
    if k * d <= EXPR_MAX_VALUES:
        return F.array_min(F.array(*[F.struct(_dist2_to(x, c).alias("d"), F.lit(i).alias("i"))
                                     for i, c in enumerate(centres)]))
    return _nearest_udf(centres)(F.col(x))


def assign(df: DataFrame, centres: list[list[float]], x: str = "x", out: str = "cluster") -> DataFrame:
    """Nearest centre by Euclidean distance; ties go to the lowest centre index.

    Small models inline the centres as literals (one codegen'd expression);
    larger ones use an Arrow-batched pandas UDF that computes the distance
    matrix of each batch in numpy.
    """
    return df.withColumn(out, _nearest(x, centres)["i"].cast("int"))


def assign_with_distance(df: DataFrame, centres: list[list[float]], x: str = "x") -> DataFrame:
    return (df.withColumn("_best", _nearest(x, centres))
            .withColumn("cluster", F.col("_best.i").cast("int"))
            .withColumn("d2", F.col("_best.d")).drop("_best"))


def lloyd_step(df: DataFrame, centres: list[list[float]], x: str = "x") -> DataFrame:
    """One update: assign, then the mean of each cluster (one row per cluster)."""
    d = len(centres[0])
    return (assign(df, centres, x).groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(x)[i]).alias(f"c{i}") for i in range(d)]))


def inertia(df: DataFrame, centres: list[list[float]], x: str = "x") -> DataFrame:
    """Sum of squared distances to the nearest centre."""
    return assign_with_distance(df, centres, x).agg(F.sum("d2").alias("inertia"))


PART_ROWS = 20_000  # rows a task, as far as there are cores for more tasks


def _lloyd(rows: DataFrame, centres: list[list[float]], max_iter: int, tol: float) -> tuple[list[list[float]], float, int]:
    """(centres, cost, steps): Lloyd steps on ``rows`` (x) until no centre moves
    by more than ``tol``, as Spark ML takes them: the cost is that of the last
    step's assignment, and a centre without rows stays. A step is one job with
    as many tasks as ``rows`` has partitions, each of which returns k sums."""
    at = np.asarray(centres, dtype=np.float64)
    for step in range(1, max_iter + 1):
        def sums(batches, at=at):
            k, d = at.shape
            n, cost, total = np.zeros(k), np.zeros(k), np.zeros((k, d))
            chunk = max(1, CHUNK_VALUES // at.size)
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                for lo in range(0, len(x), chunk):
                    part = x[lo:lo + chunk]
                    d2 = ((part[:, None, :] - at[None]) ** 2).sum(-1)
                    near = d2.argmin(axis=1)
                    n += np.bincount(near, minlength=k)
                    cost += np.bincount(near, weights=d2[np.arange(len(part)), near], minlength=k)
                    for i in range(d):
                        total[:, i] += np.bincount(near, weights=part[:, i], minlength=k)
            yield pa.RecordBatch.from_pylist([{"n": float(n[c]), "cost": float(cost[c]), "total": total[c].tolist(), "c": c} for c in range(k)],
                                             schema=pa.schema([("n", pa.float64()), ("cost", pa.float64()), ("total", pa.list_(pa.float64())), ("c", pa.int32())]))

        got = rows.mapInArrow(sums, "n double, cost double, total array<double>, c int").collect()  # k rows a task
        n, new, cost = np.zeros(len(at)), np.zeros_like(at), 0.0
        for r in got:
            n[r["c"]] += r["n"]
            new[r["c"]] += r["total"]
            cost += r["cost"]
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], at)
        moved = ((new - at) ** 2).sum(axis=1).max()
        at = new
        if moved <= tol * tol:
            break
    return at.tolist(), float(cost), step


def kmeans_fit(df: DataFrame, key: str, k: int = 3, init: str = "k-means++", max_iter: int = 300,
               seed: int = 42, x: str = "x", n_init: int | None = None, tol: float = 1e-4,
               canonical: bool = True) -> KMeansFit:
    """KMeans, seeded by Spark ML. ``k-means++`` uses Spark's parallel k-means|| seeding
    (one run); ``random`` keeps the best of ``n_init`` (default 10) seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = df.select(F.col(key), array_to_vector(x).alias("features"), F.col(x).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    mode = "random" if init == "random" else "k-means||"
    runs = n_init or (10 if mode == "random" else 1)
    n = data.count()
    few = data.select("x").coalesce(max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)))).persist(StorageLevel.MEMORY_AND_DISK)
    best = None
    for r in range(runs):
        # Spark ML seeds and takes the first step; the other steps are one short job each
        model = KMeans(k=k, initMode=mode, maxIter=1, seed=seed + r, tol=tol).fit(data.select("features"))
        start = [list(map(float, c)) for c in model.clusterCenters()]
        got = _lloyd(few, start, max_iter - 1, tol) if max_iter > 1 else (start, model.summary.trainingCost, 0)
        if best is None or got[1] < best[1]:
            best = got
    centres, cost, iters = best[0], best[1], best[2] + 1
    few.unpersist()
    data.unpersist()
    if not canonical:
        return KMeansFit(centres, float(cost), int(iters))
    # canonical numbering: clusters ordered by their smallest key
    lab = assign(df.select(key, x), centres, x, "raw")
    order = [r["raw"] for r in lab.groupBy("raw").agg(F.min(key).alias("m")).orderBy("m").collect()]
    used = [centres[i] for i in order]
    return KMeansFit(used, float(cost), int(iters))


PARALLEL = 8  # fits that run side by side


def side_by_side(df: DataFrame, tasks: list[Callable]) -> list:
    """Results of independent fits on persisted rows, in order. Every iteration
    is a short job, so one fit alone leaves most cores idle."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPool(min(len(tasks), PARALLEL)) as pool:
        return pool.map(lambda t: t(), [inheritable_thread_target(df.sparkSession)(t) for t in tasks], chunksize=1)


def kmeans(df: DataFrame, key: str, k: int = 3, init: str = "k-means++", max_iter: int = 300,
           seed: int = 42, x: str = "x") -> DataFrame:
    fit = kmeans_fit(df, key, k, init, max_iter, seed, x)
    return assign(df.select(key, x), fit.centres, x).select(key, "cluster")


def elbow(df: DataFrame, key: str, max_k: int = 10, x: str = "x", seed: int = 42) -> DataFrame:
    """(k, inertia) for k = 2..max_k on the persisted feature table."""
    data = df.select(key, x).persist(StorageLevel.MEMORY_AND_DISK)
    data.count()  # stored once, before the fits read it
    ks = list(range(2, max_k + 1))
    fits = side_by_side(data, [partial(kmeans_fit, data, key, k, seed=seed, x=x, canonical=False) for k in ks])
    rows = [(k, fit.inertia) for k, fit in zip(ks, fits, strict=True)]
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")
