"""Exact k nearest neighbours by a box join, and the k-distance curve.

Space is cut into boxes of about ``leaf_rows`` points by a k-d tree over a
bounded sample. Every query first meets the points of its own box, which
bounds the distance of its k-th neighbour from above. It then visits exactly
those other boxes that are not farther away than that bound: the nearest
unexplored box lies beyond the k-th distance when it stops. Distances to the
boxes (smallest and largest coordinates of their points, in all dimensions)
never exceed the distances to the points inside, not even by rounding, so no
neighbour and no tie is lost. No pair outside touching boxes is looked at.

Equal vectors are collapsed: of the points with one vector only the few with
the smallest ids can be among the k nearest, and equal queries are answered
once. A box that still holds too many points is dealt into parts by id, and
the queries of a box into parts as well, so a task holds a bounded number of
rows on either side. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import join_shared
from tessera.operators.graph import dense_index
from tessera.operators.pairs import vector_dim
from tessera.session import ensure_checkpoint_dir

LEAF_ROWS = 2000
MAX_LEAVES = 100_000
#: Sampled points a box, and values of all sampled points at most (they come to the driver).
SAMPLE = 16
SAMPLE_VALUES = 8_000_000
CHUNK = 1 << 22
_SPLITS = 256
_FOUND = "id long, x array<double>, nb array<long>, d2 array<double>"


# ------------------------------------------------------------------- boxes

@dataclass
class Boxes:
    """A binary tree: inner nodes with axis and cut, leaves numbered; ``lo``
    and ``hi`` bound the points below a node, ``parts`` those of a leaf."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray   # child node; ~leaf for a leaf
    right: np.ndarray
    lo: np.ndarray | None = None      # of leaves
    hi: np.ndarray | None = None
    parts: np.ndarray | None = None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.axis) else np.full(len(x), ~0, np.int64)
        while True:
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                return ~at
            node = at[inner]
            below = x[inner, self.axis[node]] < self.cut[node]
            at[inner] = np.where(below, self.left[node], self.right[node])

    def close_inner(self) -> None:
        """Boxes of inner nodes from those of their children (children come after parents)."""
        n, d = len(self.axis), self.lo.shape[1]
        self.inner_lo, self.inner_hi = np.full((n, d), np.inf), np.full((n, d), -np.inf)
        for i in range(n - 1, -1, -1):
            for child in (self.left[i], self.right[i]):
                lo, hi = (self.inner_lo[child], self.inner_hi[child]) if child >= 0 else (self.lo[~child], self.hi[~child])
                self.inner_lo[i], self.inner_hi[i] = np.minimum(self.inner_lo[i], lo), np.maximum(self.inner_hi[i], hi)

    def within(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is not farther than ``limit`` (squared)."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64) if len(self.axis) else np.full(len(x), ~0, np.int64)
        out_r, out_l = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rows):
            leaf = nodes < 0
            lo = np.where(leaf[:, None], self.lo[np.where(leaf, ~nodes, 0)], self.inner_lo[np.where(leaf, 0, nodes)] if len(self.axis) else 0)
            hi = np.where(leaf[:, None], self.hi[np.where(leaf, ~nodes, 0)], self.inner_hi[np.where(leaf, 0, nodes)] if len(self.axis) else 0)
            d2 = np.zeros(len(rows))
            for i in range(x.shape[1]):
                gap = np.maximum(np.maximum(lo[:, i] - x[rows, i], x[rows, i] - hi[:, i]), 0)
                d2 += gap * gap
            near = d2 <= limit[rows]
            done = near & leaf
            out_r.append(rows[done])
            out_l.append(~nodes[done])
            go = near & ~leaf
            rows, nodes = rows[go], nodes[go]
            rows, nodes = np.concatenate([rows, rows]), np.concatenate([self.left[nodes], self.right[nodes]])
        return np.concatenate(out_r), np.concatenate(out_l)


def _grown(sample: np.ndarray, leaves: int) -> Boxes:
    """Cut at medians of the widest axis until there are about ``leaves`` parts."""
    axis, cut, left, right = [], [], [], []
    n_leaves = 0
    todo = [(np.arange(len(sample)), -1, 0)]  # rows, parent, side
    least = max(2, len(sample) // max(1, leaves))
    while todo:
        rows, parent, side = todo.pop(0)
        me = None
        if len(rows) > least:
            part = sample[rows]
            a = int(part.var(axis=0).argmax())
            c = float(np.median(part[:, a]))
            below = part[:, a] < c
            if not below.any():  # the median is the smallest value: cut above it
                above = part[part[:, a] > c, a]
                c = float(above.min()) if len(above) else c
                below = part[:, a] < c
            if below.any() and not below.all():
                me = len(axis)
                axis.append(a)
                cut.append(c)
                left.append(0)
                right.append(0)
                todo += [(rows[below], me, 0), (rows[~below], me, 1)]
        if me is None:
            me = ~n_leaves
            n_leaves += 1
        if parent >= 0:
            (left if side == 0 else right)[parent] = me
    return Boxes(np.array(axis, np.int64), np.array(cut, float), np.array(left, np.int64), np.array(right, np.int64))


# ------------------------------------------------------------ within a task

def smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest values of each row, earlier columns first at
    ties. Only values up to the k-th are sorted."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    bound = np.partition(d, k - 1, axis=1)[:, k - 1: k]
    out = np.empty((len(d), k), np.int64)
    for i, (row, top) in enumerate(zip(d, bound, strict=True)):
        near = np.flatnonzero(row <= top)
        out[i] = near[np.argsort(row[near], kind="stable")[:k]]
    return out


def _top(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int):
    """(ids, squared distances) of the k nearest points of every query; ``ids`` ascending."""
    k = min(k, len(p))
    nb, out = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    step = max(1, CHUNK // max(1, len(p)))
    for lo in range(0, len(q), step):
        part = q[lo: lo + step]
        d2 = np.zeros((len(part), len(p)))
        for i in range(q.shape[1]):
            diff = part[:, i, None] - p[None, :, i]
            d2 += diff * diff
        at = smallest(d2, k)
        nb[lo: lo + step], out[lo: lo + step] = ids[at], np.take_along_axis(d2, at, axis=1)
    return nb, out


def _stack(col) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _meet(k: int):
    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "x": [], "nb": [], "d2": []})
        p = p.sort_values("id", kind="stable")
        nb, d2 = _top(_stack(q["x"]), _stack(p["x"]), p["id"].to_numpy(), k)
        if "limit" in q:  # beyond the first box only what can still be among the k nearest
            keep = [row <= top for row, top in zip(d2, q["limit"].to_numpy(), strict=True)]
            nb, d2 = [r[m] for r, m in zip(nb, keep, strict=True)], [r[m] for r, m in zip(d2, keep, strict=True)]
        return pd.DataFrame({"id": q["id"].to_numpy(), "x": q["x"].to_numpy(), "nb": list(nb), "d2": list(d2)})
    return run


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


# -------------------------------------------------------------------- steps

def _first_ids(points: DataFrame, need: int) -> DataFrame:
    """Of the points with one vector, the ``need`` smallest ids: in parts first, then over the parts."""
    if points.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > need).isEmpty():
        return points
    part = F.pmod(F.xxhash64("id"), F.lit(_SPLITS))
    some = points.withColumn("_r", F.row_number().over(Window.partitionBy("x", part).orderBy("id"))).where(F.col("_r") <= need)
    return (some.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy("id")))
            .where(F.col("_r") <= need).select("id", "x"))


def _with_leaf(df: DataFrame, boxes: Boxes, dim: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                leaf = boxes.leaf_of(_matrix(b.column("x"), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*b.schema.names, "leaf"])
    return df.mapInArrow(run, "id long, x array<double>, leaf int")


def _constant(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>")


def _cogrouped(q: DataFrame, p: DataFrame, salts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Queries and points that meet in the same box; the queries of a box in
    ``salts`` parts, its points once for each part."""
    few = F.broadcast(salts)  # one row a box: bounded by the number of boxes
    q = q.join(few, keys).withColumn("_s", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    p = p.join(few, keys).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    run = _meet(k)
    drop = [*keys, "_s"]
    return q.groupBy(*keys, "_s").cogroup(p.groupBy(*keys, "_s")).applyInPandas(
        lambda a, b: run(a.drop(columns=drop), b.drop(columns=drop)), _FOUND)


def _salts(visits: DataFrame, keys: list[str], leaf_rows: int) -> DataFrame:
    return visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * leaf_rows)).cast("int").alias("salts"))


def _boxed(queries: DataFrame, points: DataFrame, n: int, need: int, dim: int, leaf_rows: int) -> DataFrame:
    """``(id, found)`` for distinct queries, ``found`` the sorted (d2, nb)."""
    leaves = min(MAX_LEAVES, -(-n // leaf_rows))
    want = min(n, SAMPLE * leaves, max(leaves, SAMPLE_VALUES // dim))
    grains = 1 << 30
    chosen = points.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(grains)) < max(1, int(grains * want / n))).select("x").collect()
    boxes = _grown(np.array([r["x"] for r in chosen], float).reshape(-1, dim), leaves)
    p = _with_leaf(points, boxes, dim).checkpoint(eager=True)
    size = len(boxes.axis) + 1
    boxes.lo, boxes.hi, boxes.parts = np.full((size, dim), np.inf), np.full((size, dim), -np.inf), np.zeros(size, np.int64)
    edges = [f(F.col("x")[i]).alias(f"{a}{i}") for i in range(dim) for a, f in (("l", F.min), ("h", F.max))]
    for r in p.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *edges).collect():  # one row a box
        boxes.lo[r["leaf"]], boxes.hi[r["leaf"]] = [r[f"l{i}"] for i in range(dim)], [r[f"h{i}"] for i in range(dim)]
        boxes.parts[r["leaf"]] = -(-r["n"] // (2 * leaf_rows))
    boxes.close_inner()
    parts = F.greatest(F.get(_constant(boxes.parts), F.col("leaf")), F.lit(1))
    p = p.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    q = _with_leaf(queries, boxes, dim).withColumn("part", F.lit(0)).checkpoint(eager=True)
    keys = ["leaf", "part"]
    own = _cogrouped(q, p, _salts(q, keys, leaf_rows), keys, need)
    top = F.when(F.size("d2") >= need, F.array_max("d2")).otherwise(F.lit(float("inf")))
    own = q.select("id", "x").join(own.select("id", "nb", "d2"), "id", "left").withColumn("limit", F.coalesce(top, F.lit(float("inf")))).checkpoint(eager=True)

    def visits(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, limit = _matrix(b.column("x"), dim), b.column("limit").to_numpy()
            mine = boxes.leaf_of(x)
            row, leaf = boxes.within(x, limit)
            reps = boxes.parts[leaf]
            row, leaf = np.repeat(row, reps), np.repeat(leaf, reps)
            part = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
            go = (leaf != mine[row]) | (part > 0)
            row = row[go]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), b.column("x").take(pa.array(row)), pa.array(limit[row]),
                 pa.array(leaf[go].astype(np.int32)), pa.array(part[go].astype(np.int32))], ["id", "x", "limit", "leaf", "part"])

    others = own.select("id", "x", "limit").mapInArrow(visits, "id long, x array<double>, limit double, leaf int, part int").checkpoint(eager=True)
    more = _cogrouped(others, p, _salts(others, keys, leaf_rows), keys, need)
    both = own.select("id", "nb", "d2").unionByName(more.select("id", "nb", "d2")).where("nb is not null")
    return both.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d2", "nb")))), 1, need).alias("found"))


def _in_one_box(queries: DataFrame, points: DataFrame, need: int, dim: int) -> DataFrame:
    """As ``_boxed`` for points of a single box, which go along with the task."""
    rows = points.orderBy("id").collect()  # at most leaf_rows
    p, ids = np.array([r["x"] for r in rows], float).reshape(-1, dim), np.array([r["id"] for r in rows], np.int64)

    def run(batches):
        for b in batches:
            if b.num_rows:
                nb, d2 = _top(_matrix(b.column("x"), dim), p, ids, need)
                k = nb.shape[1]
                off = pa.array(np.arange(0, (len(nb) + 1) * k, k, dtype=np.int32)) if k else pa.array(np.zeros(len(nb) + 1, np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(d2.ravel()), pa.array(nb.ravel())], ["d2", "nb"])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(off, pairs)], ["id", "found"])

    return queries.mapInArrow(run, "id long, found array<struct<d2:double,nb:long>>")


# ------------------------------------------------------------------- public

def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(id, rank, nb, d2)``: for every row of ``queries`` (``id`` unique,
    ``x``) its k nearest rows of ``points``, rank 1 the nearest, fewer if
    there are fewer points. ``exclude_self`` leaves out the point with the
    query's own id. Rows whose ``x`` is null are left out on both sides; no
    value of ``x`` may be null or NaN."""
    if k < 1 or leaf_rows < 1:
        raise ValueError("k and leaf_rows must be at least 1")
    out = "id long, rank int, nb long, d2 double"
    clean = [d.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null") for d in (queries, points)]
    need = k + int(exclude_self)
    ensure_checkpoint_dir(queries.sparkSession)
    pts = _first_ids(clean[1], need).checkpoint(eager=True)
    n = pts.count()
    if n == 0 or clean[0].isEmpty():
        return queries.sparkSession.createDataFrame([], out)
    dim = vector_dim(pts)
    asked = clean[0].groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    repeated = not asked.where("n > 1").isEmpty()
    each = asked.select("id", "x")
    found = _in_one_box(each, pts, need, dim) if n <= leaf_rows else _boxed(each, pts, n, need, dim, leaf_rows)
    if repeated:
        by_x = found.join(each, "id").select("x", "found")
        found = join_shared(clean[0], by_x, ["x"]).select("id", "found")
    if exclude_self:
        found = found.withColumn("found", F.filter("found", lambda f: f["nb"] != F.col("id")))
    return found.select("id", F.posexplode(F.slice("found", 1, k)).alias("rank", "f")).select(
        "id", (F.col("rank") + 1).alias("rank"), "f.nb", "f.d2")


def k_distance(df: DataFrame, key: str, k: int = 5, x: str = "x", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(key, k_distance)``: every row's distance to its k-th nearest other
    row (equal rows count); null where there are fewer others."""
    rows = df.select(F.col(key).alias("id"), F.col(x).alias("x"))
    last = nearest(rows, rows, k, exclude_self=True, leaf_rows=leaf_rows).where(F.col("rank") == k)
    return rows.join(last.select("id", F.sqrt("d2").alias("k_distance")), "id", "left").select(F.col("id").alias(key), "k_distance")


def k_distance_curve(distances: DataFrame, key: str) -> DataFrame:
    """The distances in ascending order: ``(position, key, k_distance)``, from 0; ties by key."""
    order = distances.where("k_distance is not null").select(F.struct("k_distance", F.col(key).alias("key")).alias("_m"))
    return dense_index(order, "_m", out="position").select(F.col("position").cast("long").alias("position"), F.col("_m.key").alias(key), F.col("_m.k_distance").alias("k_distance"))


def suggest_eps(distances: DataFrame, points: int = 101) -> float | None:
    """The knee of the sorted curve: of ``points`` quantiles (exact), the one
    farthest below the straight line from the first to the last. Null without
    distances; the only value if all are equal."""
    from tessera.functions.quantiles import quantiles
    probs = np.linspace(0, 1, points)
    got = quantiles(distances, ["k_distance"], probs.tolist())["k_distance"]
    if got is None:
        return None
    y = np.array(got)
    below = y[0] + (y[-1] - y[0]) * probs - y
    return float(y[int(below.argmax())])
