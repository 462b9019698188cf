"""Clustering quality: cluster/noise counts, exact silhouette (Euclidean),
Davies-Bouldin, Calinski-Harabasz. Noise (-1) is excluded everywhere.

A score needs at least two valid rows and 2 <= clusters <= rows - 1;
otherwise it is NULL.

Silhouette is quadratic by definition. Rows are dealt into blocks of about
``block_rows``; a task holds one block and streams all rows past it, adding
up distance sums per cluster, so it returns one value per row and neither
pairs nor row-cluster sums are written out. For a linear-time score on
very large tables use :func:`silhouette_squared` (Spark ML's squared-
distance variant), which is a different metric.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, sq_dist

def _row_id(df: DataFrame, key: str) -> Column:
    """A whole number that tells rows apart: an integer key itself, else its hash."""
    return F.col(key).cast("long") if dict(df.dtypes).get(key) in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)


BLOCK_CLUSTERS = 1000  # clusters compared at a time


def cluster_counts(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labels.agg(
        F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("clusters"),
        F.count(F.when(F.col(cluster) == -1, 1)).alias("noise"))


def _valid(df: DataFrame, key: str, x: str, cluster: str) -> DataFrame:
    return df.where(F.col(cluster) != -1).select(_row_id(df, key).alias("id"), F.col(x).alias("x"),
                                                 F.col(cluster).cast("int").alias("c"))


def _fresh(df: DataFrame) -> DataFrame:
    """Same columns under new attribute ids (avoids self-join ambiguity)."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _scorable(valid: DataFrame) -> tuple[bool, int, int]:
    r = collect_row(valid, F.count(F.lit(1)).alias("n"), F.count_distinct("c").alias("k"))
    n, k = r["n"], r["k"]
    return (n >= 2 and 2 <= k <= n - 1), n, k


def centroids(valid: DataFrame, dim: int) -> DataFrame:
    """(c, n, centroid array) per cluster: one row per cluster."""
    return valid.groupBy("c").agg(F.count(F.lit(1)).alias("n"),
                                  F.array(*[F.avg(F.col("x")[i]) for i in range(dim)]).alias("cx"))


def _with_centroid(valid: DataFrame, cents: DataFrame) -> DataFrame:
    return valid.join(cents, "c")  # broadcast when measured small, else shuffled


def davies_bouldin(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster", dim: int | None = None) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j), s = mean distance to centroid."""
    from tessera.operators.pairs import vector_dim
    valid = _valid(df, key, x, cluster)
    ok, _, k = _scorable(valid)
    if not ok:
        return df.sparkSession.createDataFrame([(None,)], "davies_bouldin double")
    return _davies_bouldin(valid.withColumn("g", F.lit(0)), dim or vector_dim(valid), k).select("davies_bouldin")


def calinski_harabasz(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster",
                      dim: int | None = None) -> DataFrame:
    """between-SS (n - k) / (within-SS (k - 1)); within-SS = 0 gives 1."""
    from tessera.operators.pairs import vector_dim
    valid = _valid(df, key, x, cluster)
    ok, n, k = _scorable(valid)
    spark = df.sparkSession
    if not ok:
        return spark.createDataFrame([(None,)], "calinski_harabasz double")
    dim = dim or vector_dim(valid)
    overall = collect_row(valid, *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dim)])
    mx = F.array(*[F.lit(overall[f"m{i}"]) for i in range(dim)])
    cents = centroids(valid, dim)
    # between-SS as a sum over rows of |c(row) - mean|^2 = sum_k n_k |c_k - mean|^2
    with_c = _with_centroid(valid, cents).withColumn("mx", mx)
    res = with_c.agg(F.sum(sq_dist("x", "cx", dim)).alias("w"), F.sum(sq_dist("cx", "mx", dim)).alias("b"))
    return res.select(
        F.when(F.col("w") == 0, F.lit(1.0))
        .otherwise(F.col("b") * F.lit(float(n - k)) / (F.col("w") * F.lit(float(k - 1)))).alias("calinski_harabasz"))


def _deal(rows: DataFrame, group: list[str], parts: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt into ``parts`` row blocks per group; every block gets its own
    rows (side 0) and, behind them, all rows of the group as partners (side 1),
    either in the ``order`` of these columns."""
    own = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("side", F.lit(0))
    partners = rows.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(1))
    return own.unionByName(partners).repartition(*group, "rb").sortWithinPartitions(*group, "rb", "side", *order)


def _streams(batches, keys: list[str]):
    """((key values, side), record batch) for runs of rows with equal keys and side."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "side")]
        cut = np.zeros(b.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        ends = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            yield tuple(c[lo] for c in cols), b.slice(lo, hi - lo)


def _vectors(b) -> np.ndarray:
    x = b.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


class _Silhouette:
    """One row block: distance sums to every cluster of every labelling,
    added up while the partners stream by, then one value per row."""

    def __init__(self):
        self.own, self.sums, self.sizes = [], {}, {}

    def add_own(self, b) -> None:
        self.own.append((b.column("id").to_numpy(), _vectors(b), np.array(b.column("cs").to_pylist(), dtype=np.int64)))

    def add_partners(self, b) -> None:
        if isinstance(self.own, list):
            self.own = tuple(np.concatenate(c) for c in zip(*self.own, strict=True))
            self.order = np.argsort(self.own[0], kind="stable")
        step = max(1, CHUNK_VALUES // len(self.own[0]))  # distances held at once
        for lo in range(0, b.num_rows, step):
            self._add(b.slice(lo, step))

    def _add(self, b) -> None:
        ids, x, _ = self.own
        other, y, labels = b.column("id").to_numpy(), _vectors(b), np.array(b.column("cs").to_pylist(), dtype=np.int64)
        # exact zero of a row to itself (the expansion below leaves rounding noise)
        order = self.order
        at = np.minimum(np.searchsorted(ids, other, sorter=order), len(ids) - 1)
        hit = np.flatnonzero(ids[order[at]] == other)
        same = hit[(x[order[at[hit]]] == y[hit]).all(axis=1)]
        own = order[at[same]]
        # a large common offset would eat the digits of the products below
        u, v = x - x[0], y - x[0]
        uu, vv, vt = (u * u).sum(1)[:, None], (v * v).sum(1)[None, :], np.ascontiguousarray(v.T)
        # partners come sorted by their clusters: those alike in all labellings are added up once
        start = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]).any(axis=1)))
        alike, n = np.empty((len(x), len(start))), np.diff(np.append(start, len(labels)))
        rows = max(1, TILE_VALUES // len(y))  # a few rows at a time stay in the cache
        room = np.empty((2, rows, len(y)))
        for lo in range(0, len(x), rows):
            hi = min(lo + rows, len(x))
            d, twice = room[0, : hi - lo], room[1, : hi - lo]
            np.matmul(2.0 * u[lo:hi], vt, out=twice)
            np.add(uu[lo:hi], vv, out=d)
            np.subtract(d, twice, out=d)
            np.maximum(d, 0.0, out=d)
            np.sqrt(d, out=d)
            mine = (own >= lo) & (own < hi)
            d[own[mine] - lo, same[mine]] = 0.0
            np.add.reduceat(d, start, axis=1, out=alike[lo:hi])
        for g in range(labels.shape[1]):
            found, at = np.unique(labels[start, g], return_inverse=True)
            member = np.zeros((len(start), len(found)))
            member[np.arange(len(start)), at] = 1.0
            sizes = np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)
            for c, total, size in zip(found.tolist(), (alike @ member).T, sizes.tolist(), strict=True):
                if c == -1:
                    continue
                key = (g, c)
                self.sums[key] = total if key not in self.sums else self.sums[key] + total
                self.sizes[key] = self.sizes.get(key, 0) + size

    def result(self):
        ids, _, labels = self.own
        out = []
        for g in range(labels.shape[1]):
            keys = [k for k in self.sums if k[0] == g]
            rows = np.flatnonzero(labels[:, g] != -1)
            if not keys or not len(rows):
                continue
            c = np.array([k[1] for k in keys])
            n = np.array([self.sizes[k] for k in keys], float)
            sums = np.stack([self.sums[k][rows] for k in keys], axis=1)
            mine = labels[rows, g][:, None] == c[None, :]
            own_n = (mine * n).sum(1)
            a = np.where(mine, sums, 0).sum(1) / np.maximum(own_n - 1, 1)
            b = np.where(mine, np.inf, sums / n).min(1)
            top = np.maximum(a, b)
            s = np.where((own_n <= 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))
            out.append((ids[rows], np.full(len(rows), g, np.int32), labels[rows, g], s))
        return out


CHUNK_VALUES = 1 << 23
TILE_VALUES = 1 << 16
BLOCK_ROWS, MAX_BLOCK_ROWS = 2048, 65_536


def _blocks_for(rows: DataFrame, n: int, block_rows: int | None) -> int:
    """Number of row blocks: each gets a copy of all rows, so blocks are as
    large as still gives every core two of them, up to ``MAX_BLOCK_ROWS``."""
    if block_rows is None:
        cores = max(1, int(rows.sparkSession.conf.get("spark.default.parallelism", "0")) or rows.sparkSession.sparkContext.defaultParallelism)
        block_rows = max(BLOCK_ROWS, min(MAX_BLOCK_ROWS, math.ceil(n / (2 * cores))))
    return max(1, math.ceil(n / block_rows))


def _silhouettes(rows: DataFrame, n: int, block_rows: int | None) -> DataFrame:
    """(id, g, c, s) from rows (id, x, cs): cs has a row's cluster in every
    labelling. The distance block of a row block and a partner batch is
    computed once for all labellings, and only one value per row and
    labelling leaves the task."""
    import pyarrow as pa

    def run(batches):
        here, block = None, None

        def flush():
            for ids, g, c, s in block.result():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(g), pa.array(c), pa.array(s)], ["id", "g", "c", "s"])

        for (rb, side), b in _streams(batches, ["rb"]):
            if rb != here:
                if block is not None:
                    yield from flush()
                here, block = rb, _Silhouette()
            (block.add_partners if side else block.add_own)(b)
        if block is not None:
            yield from flush()

    return _deal(rows, [], _blocks_for(rows, n, block_rows), ("cs",)).mapInArrow(run, "id long, g int, c long, s double")


def silhouette_rows(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster", block_rows: int | None = None) -> DataFrame:
    """Per-row silhouette (key, c, s) over the non-noise rows."""
    valid = df.where(F.col(cluster) != -1).select(F.col(key), _row_id(df, key).alias("id"), F.col(x).alias("x"),
                                                  F.array(F.col(cluster).cast("int")).alias("cs"))
    s = _silhouettes(valid.select("id", "x", "cs"), valid.count(), block_rows)
    return valid.select(key, "id").join(s, "id").select(F.col(key).alias("id"), F.col("c").cast("int").alias("c"), "s")


def silhouette(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster", block_rows: int | None = None) -> DataFrame:
    valid = _valid(df, key, x, cluster)
    ok, n, _ = _scorable(valid)
    if not ok:
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")
    rows = valid.select("id", "x", F.array("c").alias("cs"))
    return _silhouettes(rows, n, block_rows).agg(F.avg("s").alias("silhouette"))


def _worst_ratios(clusters: DataFrame, parts: int) -> DataFrame:
    """(g, r, zero): per cluster the largest (s_i + s_j) / d_ij over the other
    clusters of its labelling, from rows (g, id, x, s); in blocks."""
    import pyarrow as pa

    def run(batches):
        here, own, best = None, None, None

        def flush():
            ids, _, _ = own
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), here[0], np.int32)), pa.array(best[0]), pa.array(best[1])], ["g", "r", "far"])

        for (g, rb, side), b in _streams(batches, ["g", "rb"]):
            if (g, rb) != here:
                if own is not None and best is not None:
                    yield from flush()
                here, own, best = (g, rb), None, None
            part = (b.column("id").to_numpy(), _vectors(b), b.column("s").to_numpy())
            if side == 0:
                own = part if own is None else tuple(np.concatenate([u, v]) for u, v in zip(own, part, strict=True))
                continue
            if best is None:
                best = [np.full(len(own[0]), -np.inf), np.zeros(len(own[0]))]
            for lo in range(0, len(part[0]), 64):  # a slice of partners at a time: no rows x partners x features array
                ids, y, sv = (c[lo: lo + 64] for c in part)
                d = np.sqrt(((own[1][:, None, :] - y[None]) ** 2).sum(-1))
                other = own[0][:, None] != ids[None, :]
                ratio = np.where(other & (d > 0), (own[2][:, None] + sv[None, :]) / np.where(d > 0, d, 1), np.where(other, 0.0, -np.inf))
                best[0] = np.maximum(best[0], ratio.max(axis=1))
                best[1] = np.maximum(best[1], d.max(axis=1))
        if own is not None and best is not None:
            yield from flush()

    return _deal(clusters, ["g"], parts).mapInArrow(run, "g int, r double, far double")


def _davies_bouldin(valid: DataFrame, dim: int, most: int) -> DataFrame:
    """(g, davies_bouldin) from rows (g, id, x, c)."""
    cents = valid.groupBy("g", "c").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(dim)]).alias("cx"))
    intra = (_fresh(valid).join(cents, ["g", "c"]).groupBy("g", "c")
             .agg(F.first("cx").alias("x"), F.avg(F.sqrt(sq_dist("x", "cx", dim))).alias("s"))
             .select("g", F.col("c").cast("long").alias("id"), "x", "s"))
    worst = _worst_ratios(intra, max(1, math.ceil(most / BLOCK_CLUSTERS)))
    spread = _fresh(intra).groupBy("g").agg(F.max("s").alias("smax"))
    zero = (F.col("far") <= 1e-8) | (F.col("smax") <= 1e-8)
    return (worst.groupBy("g").agg(F.avg("r").alias("r"), F.max("far").alias("far")).join(spread, "g")
            .select("g", F.when(zero, F.lit(0.0)).otherwise(F.col("r")).alias("davies_bouldin")))


_exact_silhouette = silhouette


def silhouette_squared(df: DataFrame, x: str = "x", cluster: str = "cluster") -> float:
    """Spark ML's linear-time silhouette (squared Euclidean): not the exact metric."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    data = df.where(F.col(cluster) != -1).select(array_to_vector(x).alias("features"),
                                                 F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                               distanceMeasure="squaredEuclidean").evaluate(data)


def all_metrics(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster", silhouette: str = "exact") -> DataFrame:
    """clusters, noise, silhouette, davies_bouldin, calinski_harabasz (one row)."""
    counts = cluster_counts(df, cluster).collect()[0]
    if silhouette not in ("exact", "squared", "none"):
        raise ValueError(f"unknown silhouette {silhouette!r}")
    sil = None
    if silhouette == "exact":
        sil = _exact_silhouette(df, key, x, cluster).collect()[0][0]
    elif silhouette == "squared" and _scorable(_valid(df, key, x, cluster))[0]:
        sil = silhouette_squared(df, x, cluster)
    db = davies_bouldin(df, key, x, cluster).collect()[0][0]
    ch = calinski_harabasz(df, key, x, cluster).collect()[0][0]
    return df.sparkSession.createDataFrame(
        [(counts["clusters"], counts["noise"], sil, db, ch)],
        "clusters bigint, noise bigint, silhouette double, davies_bouldin double, calinski_harabasz double")


# ------------------------------------------------ many labellings at once

def scores_by(df: DataFrame, key: str, group: str, x: str = "x", cluster: str = "cluster",
              block_rows: int | None = None) -> DataFrame:
    """Silhouette and Davies-Bouldin for several labellings of the same rows
    in one pass: ``df`` has (group, key, x, cluster); the block-pair job and
    the centroid passes are grouped by ``group``. Returns (group, clusters,
    noise, silhouette, davies_bouldin), NULL scores where not computable."""
    spark = df.sparkSession
    allrows = df.select(F.col(group).cast("int").alias("g"), _row_id(df, key).alias("id"),
                        F.col(x).alias("x"), F.col(cluster).cast("int").alias("c"))
    counts = {r["g"]: r for r in allrows.groupBy("g").agg(
        F.count_distinct(F.when(F.col("c") != -1, F.col("c"))).alias("k"),
        F.count(F.when(F.col("c") == -1, 1)).alias("noise"),
        F.count(F.when(F.col("c") != -1, 1)).alias("n")).collect()}
    ok = [g for g, r in counts.items() if r["n"] >= 2 and 2 <= r["k"] <= r["n"] - 1]
    sil, db = {}, {}
    if ok:
        from tessera.operators.pairs import vector_dim
        place = {g: i for i, g in enumerate(sorted(ok))}
        good = allrows.where(F.col("g").isin(ok))
        # one row per id with its cluster in every labelling (noise where it has none)
        by_place = F.map_from_entries(F.collect_list(F.struct(F.create_map(*[v for g, i in place.items() for v in (F.lit(g), F.lit(i))])[F.col("g")].alias("i"), "c")))
        rows = (good.groupBy("id").agg(F.first("x").alias("x"), by_place.alias("m"))
                .select("id", "x", F.array(*[F.coalesce(F.col("m")[F.lit(i)], F.lit(-1)) for i in range(len(place))]).alias("cs")).persist())
        n = rows.count()
        names = {i: g for g, i in place.items()}
        sil = {names[r["g"]]: r["s"] for r in _silhouettes(rows, n, block_rows).groupBy("g").agg(F.avg("s").alias("s")).collect()}
        dim = vector_dim(rows)
        db = {r["g"]: r["davies_bouldin"] for r in
              _davies_bouldin(good.where("c <> -1"), dim, max(counts[g]["k"] for g in ok)).collect()}
        rows.unpersist()
    rows = [(int(g), int(r["k"]), int(r["noise"]), sil.get(g), db.get(g)) for g, r in counts.items()]
    return spark.createDataFrame(rows, "g int, clusters bigint, noise bigint, silhouette double, davies_bouldin double")
