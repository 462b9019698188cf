"""Birch: micro-clusters from CF-trees built inside the tasks, merged in a tree
reduction, then grouped by Ward linkage.

A micro-cluster is (n, ls, ss): number, sum and sum of squared norms of its
rows. Each task reads its rows once, a batch at a time, into a CF-tree of at
most ``max_clusters`` micro-clusters: a batch descends the tree split by the
nearest child; in a leaf, rows within ``threshold`` of the nearest
micro-cluster's centroid join it, which keeps its radius (root mean square
distance to the centroid) within ``threshold``; the others found new ones. A
tree that grows beyond its bound is rebuilt with a larger threshold. The
trees of ``fan_in`` tasks at a time are merged by inserting their
micro-clusters into one tree, until one is left. A task therefore holds at
most ``fan_in * max_clusters`` micro-clusters, however many rows there are.

Totals of n, ls and ss do not depend on the order of insertion or merging
(up to the rounding of sums); which rows share a micro-cluster does, as in
any CF-tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.agglomerative import lance_williams
from tessera.operators.kmeans import assign
from tessera.session import ensure_checkpoint_dir

MAX_CLUSTERS = 2000
FAN_IN = 8
SLICE = 512
GROWTH = 1.5
MICRO = "part long, n long, ls array<double>, ss double, threshold double"


@dataclass
class CF:
    """Micro-clusters as arrays: n (m), ls (m x d), ss (m)."""

    n: np.ndarray
    ls: np.ndarray
    ss: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    def take(self, at) -> CF:
        return CF(self.n[at], self.ls[at], self.ss[at])

    def total(self) -> CF:
        return CF(self.n.sum(keepdims=True), self.ls.sum(axis=0, keepdims=True), self.ss.sum(keepdims=True))

    def centroids(self) -> np.ndarray:
        return self.ls / self.n[:, None]

    def spread(self) -> np.ndarray:
        """Mean squared distance of the rows to the centroid."""
        return np.maximum(self.ss / self.n - (self.centroids() ** 2).sum(axis=1), 0)


def concat(parts: list[CF]) -> CF:
    return CF(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("n", "ls", "ss")))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out


@dataclass
class _Node:
    cf: CF                                              # of the entries (leaf) or children
    children: list[_Node] = field(default_factory=list)  # empty in a leaf


def _absorb(mine: CF, new: CF, limit: float) -> CF:
    """A leaf's micro-clusters with ``new`` ones absorbed or added."""
    rest = new
    if len(mine):
        d2 = _squared(rest.centroids(), mine.centroids())
        at = d2.argmin(axis=1)
        ok = d2[np.arange(len(rest)), at] + rest.spread() <= limit
        mine = _added(mine, rest.take(ok), at[ok])
        rest = rest.take(~ok)
    made = []
    while len(rest):  # the first one left founds a micro-cluster, the others near it join
        c = rest.centroids()
        ok = ((c - c[0]) ** 2).sum(axis=1) + rest.spread() <= limit
        ok[0] = True
        made.append(rest.take(ok).total())
        rest = rest.take(~ok)
    return concat([mine, *made]) if made else mine


def _added(mine: CF, new: CF, at: np.ndarray) -> CF:
    n, ls, ss = mine.n.copy(), mine.ls.copy(), mine.ss.copy()
    np.add.at(n, at, new.n)
    np.add.at(ls, at, new.ls)
    np.add.at(ss, at, new.ss)
    return CF(n, ls, ss)


def _halves(cf: CF, branching: int) -> list[np.ndarray]:
    """Places of the entries in groups of at most ``branching``, cut between
    the two that are farthest from each other's end."""
    todo, done = [np.arange(len(cf))], []
    c = cf.centroids()
    while todo:
        at = todo.pop()
        if len(at) <= branching:
            done.append(at)
            continue
        one = ((c[at] - c[at[0]]) ** 2).sum(axis=1)
        p = at[one.argmax()]
        from_p = ((c[at] - c[p]) ** 2).sum(axis=1)
        q = at[from_p.argmax()]
        near_p = from_p <= ((c[at] - c[q]) ** 2).sum(axis=1)
        if near_p.all() or not near_p.any():  # equal centroids
            near_p = np.arange(len(at)) < len(at) // 2
        todo += [at[near_p], at[~near_p]]
    return done


class CFTree:
    def __init__(self, dim: int, threshold: float, branching: int, max_clusters: int):
        self.threshold, self.branching, self.max_clusters = threshold, branching, max_clusters
        self.dim, self.size = dim, 0
        self.root = _Node(CF(np.empty(0, np.int64), np.empty((0, dim)), np.empty(0)))

    def insert(self, new: CF) -> None:
        for lo in range(0, len(new), SLICE):
            self._put(new.take(slice(lo, lo + SLICE)))
            while self.size > self.max_clusters:
                self._rebuild()

    def _put(self, new: CF) -> None:
        nodes = self._into(self.root, new)
        while len(nodes) > 1:
            nodes = self._grouped(nodes)
        self.root = nodes[0]

    def _into(self, node: _Node, new: CF) -> list[_Node]:
        """The nodes that take the place of ``node`` after insertion."""
        if not node.children:
            cf = _absorb(node.cf, new, self.threshold ** 2)
            self.size += len(cf) - len(node.cf)
            return [_Node(cf.take(at)) for at in _halves(cf, self.branching)]
        to = _squared(new.centroids(), node.cf.centroids()).argmin(axis=1)
        kids: list[_Node] = []
        for i, child in enumerate(node.children):
            mine = to == i
            kids += self._into(child, new.take(mine)) if mine.any() else [child]
        return self._grouped(kids)

    def _grouped(self, kids: list[_Node]) -> list[_Node]:
        cf = concat([k.cf.total() for k in kids])
        return [_Node(cf.take(at), [kids[i] for i in at]) for at in _halves(cf, self.branching)]

    def leaves(self) -> CF:
        todo, found = [self.root], []
        while todo:
            node = todo.pop()
            if node.children:
                todo += node.children[::-1]
            else:
                found.append(node.cf)
        return concat(found)

    def _rebuild(self) -> None:
        """The same micro-clusters in a new tree with a larger threshold."""
        old = self.leaves()
        if self.threshold <= 0:  # the typical distance to the nearest of a slice
            d2 = _squared(old.centroids()[:SLICE], old.centroids()[:SLICE])
            np.fill_diagonal(d2, np.inf)
            self.threshold = float(np.sqrt(np.median(d2.min(axis=1)))) or np.finfo(float).tiny
        self.threshold *= GROWTH
        self.size, self.root = 0, _Node(old.take(slice(0, 0)))
        for lo in range(0, len(old), SLICE):
            self._put(old.take(slice(lo, lo + SLICE)))


def _frame(part: int, tree: CFTree) -> pd.DataFrame:
    cf = tree.leaves()
    return pd.DataFrame({"part": part, "n": cf.n, "ls": list(cf.ls), "ss": cf.ss, "threshold": tree.threshold})


def _build(dim: int, threshold: float, branching: int, max_clusters: int):
    def run(batches):
        tree = CFTree(dim, threshold, branching, max_clusters)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                tree.insert(CF(np.ones(len(x), np.int64), x, (x * x).sum(axis=1)))
        if tree.size:
            yield pa.RecordBatch.from_pandas(_frame(TaskContext.get().partitionId(), tree), preserve_index=False)
    return run


def _merge(dim: int, branching: int, max_clusters: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "n", "ss"], kind="stable")
        tree = CFTree(dim, float(pdf["threshold"].max()), branching, max_clusters)
        tree.insert(CF(pdf["n"].to_numpy(), np.stack(pdf["ls"].to_numpy()), pdf["ss"].to_numpy()))
        return _frame(int(pdf["part"].iloc[0]), tree)
    return run


def micro_clusters(df: DataFrame, threshold: float = 0.5, branching: int = 50, max_clusters: int = MAX_CLUSTERS,
                   fan_in: int = FAN_IN, x: str = "x") -> DataFrame:
    """``(part, n, ls, ss, threshold)``: at most ``max_clusters`` micro-clusters
    of all rows, in one pass over them. ``threshold`` is the radius that was
    needed in the end. Rows without features (null) are left out."""
    if threshold < 0 or branching < 2 or max_clusters < 1 or fan_in < 2:
        raise ValueError("threshold >= 0, branching >= 2, max_clusters >= 1 and fan_in >= 2 are needed")
    rows = df.select(F.col(x).cast("array<double>").alias("x")).where("x is not null")
    dims = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect()]
    if len(dims) > 1:
        raise ValueError(f"feature vectors of different lengths: {sorted(dims)}")
    if not dims:
        return df.sparkSession.createDataFrame([], MICRO)
    ensure_checkpoint_dir(df.sparkSession)
    found = rows.mapInArrow(_build(dims[0], threshold, branching, max_clusters), MICRO).checkpoint(eager=True)
    while found.select("part").distinct().count() > 1:
        found = (found.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("part")
                 .applyInPandas(_merge(dims[0], branching, max_clusters), MICRO).checkpoint(eager=True))
    return found


def birch_centroids(micro: DataFrame, k: int) -> tuple[list[list[float]], list[int]]:
    """Centroids of the micro-clusters and the number of the group each
    belongs to: weighted Ward linkage cut at ``k`` groups. Both are bounded by
    ``max_clusters``."""
    rows = micro.orderBy("n", "ss", "ls").collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} micro-clusters cannot form {k} clusters; use a smaller threshold")
    c, w = np.array([r["ls"] for r in rows]) / np.array([[r["n"]] for r in rows]), np.array([r["n"] for r in rows], float)
    d = np.sqrt(2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :]) * _squared(c, c))
    np.fill_diagonal(d, np.inf)
    group = np.arange(len(c))
    for a, b, _ in lance_williams(d, w, "ward")[: len(c) - k]:
        group[group == b] = a
    return c.tolist(), np.unique(group, return_inverse=True)[1].tolist()


def birch(df: DataFrame, key: str, k: int = 3, threshold: float = 0.5, branching: int = 50,
          max_clusters: int = MAX_CLUSTERS, x: str = "x") -> DataFrame:
    """``(key, cluster)``: rows in the group of the nearest micro-cluster,
    groups numbered by their smallest key."""
    centres, group = birch_centroids(micro_clusters(df, threshold, branching, max_clusters, x=x), k)
    ensure_checkpoint_dir(df.sparkSession)
    near = assign(df.select(key, x), centres, x, "_m").select(key, F.array(*[F.lit(g) for g in group])[F.col("_m")].alias("_g")).checkpoint(eager=True)
    order = [r["_g"] for r in near.groupBy("_g").agg(F.min(key).alias("m")).orderBy("m").collect()]  # at most k rows
    numbers = F.create_map(*[c for i, g in enumerate(order) for c in (F.lit(g), F.lit(i))])
    return near.select(key, numbers[F.col("_g")].cast("int").alias("cluster"))
