"""Merges of an agglomerative round that can be decided within a box of space.

Ward, complete and average distance of two clusters are at least the distance
of their centroids. Space is cut into boxes by a k-d tree over the centroids;
centroids of clusters merged within a box stay in it. So a pair of reciprocal
nearest neighbours among the clusters of a box is one among all clusters, if
its distance is below that of either centroid to the box's sides, and can be
merged there and then (the linkages are reducible: order does not matter).

A task holds one box. It cuts it on to parts of at most half of ``limit``
clusters, merges in each what can be decided, and goes up: the clusters left in
two parts are merged in their common box, as long as they are at most ``limit``
(their distance matrix is the largest thing held). Distances between clusters
are reduced from the members' as they come, a chunk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import Boxes

MERGES = "merge boolean, left long, right long, height double, size long"
TILE = (32, 1024)  # distances held at once: they stay in the cache
SHARES = (0.5, 0.36, 0.64, 0.43)  # of the clusters below a cut, by pass
SAMPLE_BOX = 512  # sampled centroids a box, for the cuts


def squared(x: np.ndarray, yt: np.ndarray, out: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the columns of yt, a dimension at a
    time: equal bits in both directions."""
    np.subtract(x[:, 0, None], yt[0], out=out)
    np.multiply(out, out, out=out)
    for d in range(1, x.shape[1]):
        np.subtract(x[:, d, None], yt[d], out=buf)
        np.multiply(buf, buf, out=buf)
        np.add(out, buf, out=out)
    return out


def reduced(xa: np.ndarray, wa: np.ndarray, sa: np.ndarray, xb: np.ndarray, wb: np.ndarray, sb: np.ndarray, linkage: str, half: bool = False) -> np.ndarray:
    """Maximum (complete), minimum (single) or weighted sum (average) of the
    members' distances, of a's clusters (beginning at rows ``sa``) to b's.
    ``half``: a and b are the same, only pairs behind the diagonal count."""
    plus = {"complete": np.maximum, "single": np.minimum}.get(linkage, np.add)
    total = np.full((len(sa), len(sb)), {"complete": -np.inf, "single": np.inf}.get(linkage, 0.0))
    of, at = (np.repeat(np.arange(len(s)), np.diff(np.append(s, n))) for s, n in ((sa, len(xa)), (sb, len(xb))))
    weighted = linkage == "average" and not ((wa == 1).all() and (wb == 1).all())
    xt = np.ascontiguousarray(xb.T)
    room = np.empty((2, TILE[0] * TILE[1]))  # taken once: fresh pages cost more than the sums
    for lo in range(0, len(xa), TILE[0]):
        hi = min(lo + TILE[0], len(xa))
        rows = np.flatnonzero(np.append(True, of[lo + 1: hi] != of[lo: hi - 1]))
        row, few = of[lo], 2 * len(rows) <= hi - lo
        for left in range(int(sb[row]) if half else 0, len(xb), TILE[1]):
            right = min(left + TILE[1], len(xb))
            d, buf = (r[: (hi - lo) * (right - left)].reshape(hi - lo, right - left) for r in room)
            squared(xa[lo:hi], xt[:, left:right], d, buf)
            if linkage == "average":
                np.sqrt(d, out=d)
                if weighted:
                    d *= wa[lo:hi, None]
                    d *= wb[None, left:right]
            if few:  # whole rows at a time
                ends = np.append(rows[1:], hi - lo)
                d = np.stack([plus.reduce(d[u:v], axis=0) for u, v in zip(rows, ends, strict=True)])
            cols = np.flatnonzero(np.append(True, at[left + 1: right] != at[left: right - 1]))
            if len(cols) < right - left:
                d = plus.reduceat(d, cols, axis=1)
            if not few and len(rows) < hi - lo:
                d = plus.reduceat(d, rows, axis=0)
            here = total[row: row + len(rows), at[left]: at[left] + len(cols)]
            plus(here, d, out=here)
    return total if linkage == "average" else np.sqrt(total, out=total, where=total >= 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = squared(x, np.ascontiguousarray(y.T), np.empty((len(x), len(y))), np.empty((len(x), len(y))))
    return np.sqrt(d, out=d)


def ward(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> np.ndarray:
    d = squared(x, np.ascontiguousarray(y.T), np.empty((len(x), len(y))), np.empty((len(x), len(y))))
    return np.sqrt(2 * wx[:, None] * wy[None, :] / (wx[:, None] + wy[None, :]) * d)


class Box:
    """Clusters of a task, in the order of their names; a merged one keeps the
    place of the smaller name."""

    def __init__(self, c: np.ndarray, w: np.ndarray, x: np.ndarray, linkage: str, limit: int):
        order = np.argsort(c, kind="stable")
        c, self.pw, self.px = c[order], w[order].astype(float), x[order]
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        self.names, self.linkage, self.limit = c[start], linkage, max(2, limit)
        self.w = np.add.reduceat(self.pw, start)
        self.x = np.add.reduceat(self.px * self.pw[:, None], start, axis=0) / self.w[:, None]
        self.members = np.split(np.arange(len(c)), start[1:])
        self.near = 1e-12 * float(np.abs(self.px).max())  # rounding of centroids
        self.merges: list[tuple[int, int, float, int]] = []

    def run(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Passes with other cuts, as long as one merges a tenth of the clusters."""
        here, before, turn = np.arange(len(self.names)), np.inf, 0
        while len(here) < 0.9 * before and (turn == 0 or len(here) > max(2, self.limit // 2)):
            before, self.share = len(here), SHARES[turn % len(SHARES)]
            here, turn = self._down(here, lo, hi), turn + 1

    def _down(self, here: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if len(here) <= max(2, self.limit // 2):
            return self._merge(here, lo, hi)
        x = self.x[here]
        axis = int(x.var(axis=0).argmax())
        cut = float(np.quantile(x[:, axis], self.share))
        below = x[:, axis] < cut
        if not below.any():  # the quantile is the smallest value: cut above it
            above = x[x[:, axis] > cut, axis]
            below = x[:, axis] < (cut := float(above.min())) if len(above) else below
        if below.any():
            mid_hi, mid_lo = hi.copy(), lo.copy()
            mid_hi[axis] = mid_lo[axis] = cut
            here = np.sort(np.concatenate([self._down(here[below], lo, mid_hi), self._down(here[~below], mid_lo, hi)]))
        return self._merge(here, lo, hi) if len(here) <= self.limit else here

    def _distances(self, here: np.ndarray) -> np.ndarray:
        if self.linkage == "ward":
            return ward(self.x[here], self.w[here], self.x[here], self.w[here])
        parts = [self.members[i] for i in here]
        rows = np.concatenate(parts)
        start = np.cumsum([0] + [len(p) for p in parts[:-1]])
        d = reduced(self.px[rows], self.pw[rows], start, self.px[rows], self.pw[rows], start, self.linkage, half=True)
        if self.linkage == "average":
            d /= self.w[here][:, None] * self.w[here][None, :]
        d = np.triu(d, 1)
        return d + d.T

    def _merge(self, here: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if len(here) < 2:
            return here
        d = self._distances(here)
        np.fill_diagonal(d, np.inf)
        x, w = self.x[here].copy(), self.w[here].copy()
        alive = np.ones(len(here), bool)
        nearest = d.argmin(axis=1)
        at = np.arange(len(here))
        while True:
            side = np.minimum(x - lo, hi - x).min(axis=1)
            best = d[at, nearest]
            sure = alive & np.isfinite(best) & (best * (1 + 1e-9) + self.near < side)
            a = np.flatnonzero(sure & (nearest[nearest] == at) & (at < nearest) & sure[nearest])
            if not len(a):
                break
            a = a[np.argsort(best[a], kind="stable")]
            b = nearest[a]
            both, height = w[a] + w[b], best[a]
            for i, j, h, n in zip(here[a].tolist(), here[b].tolist(), height.tolist(), both.tolist(), strict=True):
                self.merges.append((int(self.names[i]), int(self.names[j]), h, int(n)))
                self.members[i] = np.concatenate([self.members[i], self.members[j]])
                self.members[j] = None
            x[a] = (x[a] * w[a, None] + x[b] * w[b, None]) / both[:, None]
            alive[b] = False
            if self.linkage == "ward":
                w[a] = both
                new = ward(x[a], both, x, w)
            elif self.linkage == "complete":
                new = np.maximum(d[a], d[b])
                new[:, a] = np.maximum(new[:, a], new[:, b])
            else:
                new = (w[a, None] * d[a] + w[b, None] * d[b]) / both[:, None]
                between = (w[a] * new[:, a] + w[b] * new[:, b]) / both
                between = np.triu(between, 1)
                new[:, a] = between + between.T
                w[a] = both
            w[a] = both
            new[:, ~alive] = np.inf
            new[np.arange(len(a)), a] = np.inf
            d[a], d[:, a] = new, new.T
            d[b], d[:, b] = np.inf, np.inf
            gone = np.zeros(len(here), bool)
            gone[a] = gone[b] = True
            stale = np.flatnonzero(alive & (gone | gone[nearest]))
            nearest[stale] = d[stale].argmin(axis=1)
            other = np.flatnonzero(alive & ~gone & ~gone[nearest])
            other = np.setdiff1d(other, stale, assume_unique=True)
            if len(other):  # only by rounding can a merged cluster be nearer than its parts
                k = new[:, other].argmin(axis=0)
                nearer = new[k, other] < d[other, nearest[other]]
                nearest[other[nearer]] = a[k[nearer]]
        self.x[here], self.w[here] = x, w
        return here[alive]


def grown(sample: np.ndarray, parts: int, share: float) -> Boxes:
    """At most ``parts`` leaves with about as many sampled rows each; ``share`` of
    the leaves lie below a cut, which is across the widest axis."""
    axis, cut, left, right, leaves = [], [], [], [], 0
    todo = [(np.arange(len(sample)), max(1, parts), None)]
    while todo:
        rows, n, parent = todo.pop(0)
        me = None
        if n > 1 and len(rows) > 1:
            x = sample[rows]
            a, low = int(x.var(axis=0).argmax()), min(n - 1, max(1, round(n * share)))
            c = float(np.quantile(x[:, a], low / n))
            below = x[:, a] < c
            if below.any() and not below.all():
                me = len(axis)
                axis.append(a)
                cut.append(c)
                left.append(0)
                right.append(0)
                todo += [(rows[below], low, (left, me)), (rows[~below], n - low, (right, me))]
        if me is None:
            me = ~leaves
            leaves += 1
        if parent is not None:
            parent[0][parent[1]] = me
    return Boxes(np.array(axis, np.int64), np.array(cut, float), np.array(left, np.int64), np.array(right, np.int64))


def bounds(boxes: Boxes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper sides of every leaf's part of space (infinite outside)."""
    size = len(boxes.axis) + 1
    lo, hi = np.full((size, dim), -np.inf), np.full((size, dim), np.inf)
    todo = [(0 if len(boxes.axis) else ~0, np.full(dim, -np.inf), np.full(dim, np.inf))]
    while todo:
        node, a, b = todo.pop()
        if node < 0:
            lo[~node], hi[~node] = a, b
            continue
        left, right = b.copy(), a.copy()
        left[boxes.axis[node]] = right[boxes.axis[node]] = boxes.cut[node]
        todo += [(int(boxes.left[node]), a, left), (int(boxes.right[node]), right, b)]
    return lo, hi


def by_number(df: DataFrame, number: str, parts: int) -> DataFrame:
    """Rows with ``number`` k (0 to parts - 1) in partition k: a long task each."""
    return df.repartitionById(parts, F.col(number))


def box_merges(points: DataFrame, dim: int, clusters: int, parts: int, linkage: str, limit: int, step: int) -> DataFrame:
    """Rows (merge, left, right, height, size) from points (c, w, x): the merges
    of one round in ``parts`` boxes, and for each cluster that went into another
    (merge false) its last one, ``left``."""
    total = F.sum("w").cast("double")
    cents = points.groupBy("c").agg(F.array(*[F.sum(F.col("x")[i] * F.col("w")) / total for i in range(dim)]).alias("x"))
    grains, want = 1 << 30, min(clusters, SAMPLE_BOX * parts)
    chosen = [] if parts == 1 else cents.where(F.pmod(F.xxhash64(F.lit(step), "c"), F.lit(grains)) < max(1, int(grains * want / clusters))).select("x").collect()
    boxes = grown(np.array([r["x"] for r in chosen], float).reshape(-1, dim), parts, SHARES[step % len(SHARES)])
    lo, hi = bounds(boxes, dim)

    def place(batches):
        for b in batches:
            if b.num_rows:
                leaf = boxes.leaf_of(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(leaf.astype(np.int32))], ["c", "leaf"])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        leaf, c, w = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in ("leaf", "c", "w"))
        x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False) for b in got]).reshape(-1, dim)
        for one in np.unique(leaf):
            mine = leaf == one
            box = Box(c[mine], w[mine], x[mine], linkage, limit)
            box.run(lo[one], hi[one])
            to = dict(zip(box.names.tolist(), box.names.tolist(), strict=True))
            for a, b, _, _ in reversed(box.merges):  # later merges first: a's last name is known
                to[b] = to[a]
            moved = [(b, to[b]) for _, b, _, _ in box.merges]
            if not box.merges:
                continue
            n = len(moved)
            cols = [*zip(*box.merges, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * n + [False] * n), pa.array([*cols[0], *(t for _, t in moved)], pa.int64()), pa.array([*cols[1], *(b for b, _ in moved)], pa.int64()),
                 pa.array([*cols[2], *[0.0] * n], pa.float64()), pa.array([*cols[3], *[0] * n], pa.int64())], ["merge", "left", "right", "height", "size"])

    placed = cents.mapInArrow(place, "c long, leaf int")
    return by_number(points.join(placed, "c"), "leaf", len(lo)).select("leaf", "c", "w", "x").mapInArrow(run, MERGES)
