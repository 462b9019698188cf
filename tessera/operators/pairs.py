"""Pair-producing operators: the eps-neighbourhood self-join.

The eps-join hashes points into a 2-D grid of side ``eps`` on the two
highest-variance coordinates. Two points within ``eps`` differ by less than
``eps`` on every coordinate, so they fall in the same or an adjacent cell:
joining each cell with its neighbourhood and then testing the exact
distance loses nothing, in any dimension. Only half of the 3x3
neighbourhood is joined (the own cell and four "forward" cells), which
finds every unordered pair exactly once and replicates each point 5 times
instead of 9.

Skew: a crowded cell would put all its points into one join task. Cells are
counted (a partial aggregate), and only those above ``max_cell_rows`` are
kept, at most rows / max_cell_rows of them: a table so small that it is
broadcast to give these cells a salt factor, without shuffling the points.
The probing side is split by a hash of the row id, the replicated side is
copied once per salt. Every task then holds at most ``max_cell_rows`` probe
rows of one cell.

:func:`within` reduces the rows within ``eps`` of each row without making
pairs: a task holds the own rows of one cell (a part of a crowded one) and
lets the rows of the 3x3 neighbourhood stream by, both in tiles of rows that
lie close together. Tiles that are too far apart are left out and tiles that
are wholly within reach count as one; only the others are compared row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, sq_dist
from tessera.operators.quality import _streams, _vectors

# Half neighbourhoods: the own cell plus one of each pair of opposite
# neighbours, so every pair of adjacent cells is joined in one direction only.
_HALF_2D = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
_HALF_1D = [(0, 0), (1, 0)]


def vector_dim(df: DataFrame, x: str = "x") -> int:
    row = df.select(F.size(x).alias("d")).where(F.col("d") > 0).limit(1).collect()
    if not row:
        raise ValueError("no non-empty feature vector")
    return int(row[0]["d"])


def grid_axes(pts: DataFrame, dim: int, x: str = "x") -> list[int]:
    """The (up to) two coordinates with the largest population variance."""
    if dim == 1:
        return [0]
    row = collect_row(pts, *[F.var_pop(F.col(x)[i]).alias(f"v{i}") for i in range(dim)])
    order = sorted(range(dim), key=lambda i: (-(row[f"v{i}"] or 0.0), i))
    return sorted(order[:2])


#: Crowded cells at most so many are broadcast (a few dozen bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 200_000


def _salts(base: DataFrame, max_cell_rows: int):
    """A function that adds ``salts`` to a frame with cx, cy: the number of
    parts of the cell, 1 for all cells but the crowded ones."""
    crowded = (base.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_cell_rows)
               .select("cx", "cy", F.ceil(F.col("n") / F.lit(float(max_cell_rows))).cast("int").alias("salts")))
    crowded = crowded.persist()
    n = crowded.count()
    if n == 0:
        crowded.unpersist()
        return lambda df: df.withColumn("salts", F.lit(1))
    table = F.broadcast(crowded) if n <= BROADCAST_CELLS else crowded
    return lambda df: df.join(table, ["cx", "cy"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


def eps_join(pts: DataFrame, eps: float, dim: int | None = None, x: str = "x",
             max_cell_rows: int = 20000, axes: list[int] | None = None, with_d2: bool = False,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """All unordered pairs ``(i, j)``, ``i < j``, with Euclidean distance <= eps.

    ``pts`` has columns ``id`` (orderable, unique) and ``x`` (array<double>);
    columns named in ``carry`` come along as ``<name>_i`` and ``<name>_j``.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    dim = dim or vector_dim(pts, x)
    axes = axes if axes is not None else grid_axes(pts, dim, x)
    a0 = axes[0]
    a1 = axes[1] if len(axes) > 1 else None
    base = pts.select(
        "id", F.col(x).alias("x"), *carry,
        F.floor(F.col(x)[a0] / F.lit(eps)).alias("cx"),
        (F.floor(F.col(x)[a1] / F.lit(eps)) if a1 is not None else F.lit(0).cast("long")).alias("cy"))
    salted = _salts(base, max_cell_rows)
    probe = (salted(base).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
             .select("id", "x", "cx", "cy", "salt", *[F.col(c).alias(f"{c}_1") for c in carry]))
    offsets = _HALF_2D if a1 is not None else _HALF_1D
    # a point of cell Q meets the probe cells Q - o, o in the half
    # neighbourhood: each pair of adjacent cells is joined once, and a pair
    # inside one cell is kept in id order
    shifted = base.select(
        F.col("id").alias("id2"), F.col("x").alias("x2"), *[F.col(c).alias(f"{c}_2") for c in carry],
        F.explode(F.array(*[F.struct((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"),
                                     F.lit(dx == 0 and dy == 0).alias("same"))
                            for dx, dy in offsets])).alias("c"))
    build = (salted(shifted.select("id2", "x2", "c.cx", "c.cy", "c.same", *[f"{c}_2" for c in carry]))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .drop("salts"))
    out = (probe.join(build, ["cx", "cy", "salt"])
           .where(~F.col("same") | (F.col("id") < F.col("id2")))
           .withColumn("d2", sq_dist("x", "x2", dim))
           .where(F.col("d2") <= F.lit(float(eps) * float(eps))))
    cols = [F.least("id", "id2").alias("i"), F.greatest("id", "id2").alias("j")]
    cols += [F.col("d2")] if with_d2 else []
    for c in carry:
        first = F.col("id") < F.col("id2")
        cols += [F.when(first, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(f"{c}_i"),
                 F.when(first, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(f"{c}_j")]
    return out.select(*cols)


def block_pairs(left: DataFrame, right: DataFrame, fn, schema: str, block_rows: int = 2048,
                left_rows: int | None = None, right_rows: int | None = None, key: str = "id") -> DataFrame:
    """Apply ``fn(left_block_pdf, right_block_pdf) -> pdf`` to every pair of
    (left block, right block).

    Rows are hashed into blocks of about ``block_rows``; each block is
    shipped to the tasks of its partner blocks, so a task holds at most two
    blocks and the work per task is bounded by ``block_rows**2``. ``fn``
    must reduce what it sees (sums, partial top-k) instead of returning
    pairs.
    """
    from pyspark.sql import functions as F
    nl = left_rows if left_rows is not None else left.count()
    nr = right_rows if right_rows is not None else right.count()
    bl = max(1, -(-nl // block_rows))
    br = max(1, -(-nr // block_rows))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    lx = (left.withColumn("_lb", F.pmod(F.xxhash64(key), F.lit(bl)).cast("int"))
          .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1)))))
    rx = (right.withColumn("_rb", F.pmod(F.xxhash64(key), F.lit(br)).cast("int"))
          .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(bl - 1)))))

    def run(lpdf, rpdf):
        return fn(lpdf.drop(columns=["_lb", "_rb"]), rpdf.drop(columns=["_lb", "_rb"]))

    return lx.groupBy("_lb", "_rb").cogroup(rx.groupBy("_lb", "_rb")).applyInPandas(run, schema=schema)


# ------------------------------------------- reductions over a neighbourhood

TILE = 256
CHUNK = 2048   # partners compared with a tile at a time
FINE = 4       # parts of a cell's side by which rows are ordered into tiles


def finite(x: str | Column) -> Column:
    """Whether all components are numbers: other rows are within reach of nothing."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, lowest and highest corner of the tiles of consecutive rows."""
    at = np.arange(0, len(x), TILE)
    return at, np.minimum.reduceat(x, at, axis=0), np.maximum.reduceat(x, at, axis=0)


def _reach(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the nearest and of the farthest points of the boxes.
    Added up like those of rows, so that rounding keeps their order."""
    near = far = np.zeros((len(a[0]), len(b[0])))
    for i in range(a[1].shape[1]):
        up, down = b[2][None, :, i] - a[1][:, None, i], a[2][:, None, i] - b[1][None, :, i]
        gap, span = np.maximum(np.maximum(-up, -down), 0.0), np.maximum(up, down)
        near, far = near + gap * gap, far + span * span
    return near, far


def _hits(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    d2 = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        diff = x[:, i, None] - y[None, :, i]
        diff *= diff
        d2 += diff
    return d2 <= limit


class _Own:
    """The own rows of a cell (part), and what their partners add up to."""

    def __init__(self, limit: float):
        self.limit, self.rows, self.x = limit, [], None

    def hold(self, b) -> None:
        self.rows.append((b.column("id"), _vectors(b), b.column("v").to_numpy(zero_copy_only=False)))

    def meet(self, b):
        if not self.rows:  # no own row fell into this part of the cell
            return None
        if self.x is None:
            self.x, self.v = (np.concatenate([r[k] for r in self.rows]) for k in (1, 2))
            self.box = _boxes(self.x)
            self.begin()
        y, v = _vectors(b), b.column("v").to_numpy(zero_copy_only=False)
        box = _boxes(y)
        near, far = _reach(self.box, box)
        return self.add(y, v, box[0], near <= self.limit, far <= self.limit)

    def compared(self, y, v, wanted):
        """(own rows, partners' values, hits) of the tiles ``wanted``."""
        for t in np.flatnonzero(wanted.any(axis=1)):
            mine = slice(t * TILE, (t + 1) * TILE)
            take = np.repeat(wanted[t], TILE)[:len(y)]
            yt, vt = y[take], v[take]
            for lo in range(0, len(yt), CHUNK):
                yield mine, vt[lo:lo + CHUNK], _hits(self.x[mine], yt[lo:lo + CHUNK], self.limit)

    def ids(self):
        return pa.concat_arrays([r[0] for r in self.rows])


class _Total(_Own):
    """Sum of v over the partners within reach."""

    def begin(self) -> None:
        self.out = np.zeros(len(self.x))

    def add(self, y, v, at, near, far):
        self.out += np.repeat(far @ np.add.reduceat(v, at).astype(float), TILE)[:len(self.x)]
        for mine, vt, hit in self.compared(y, v, near & ~far):
            self.out[mine] += hit.astype(float) @ vt.astype(float)

    def result(self):
        if self.x is not None:
            yield [self.ids(), pa.array(self.out.astype(np.int64))]


class _Least(_Own):
    """Smallest v of the partners within reach; rows without one are left out."""

    NONE = np.iinfo(np.int64).max

    def begin(self) -> None:
        self.out = np.full(len(self.x), self.NONE)

    def add(self, y, v, at, near, far):
        worst = np.maximum.reduceat(self.out, self.box[0])
        for mine, vt, hit in self.compared(y, v, near & (np.minimum.reduceat(v, at)[None, :] < worst[:, None])):
            self.out[mine] = np.minimum(self.out[mine], np.where(hit, vt[None, :], self.NONE).min(axis=1))

    def result(self):
        if self.x is not None:
            some = self.out != self.NONE
            yield [self.ids().filter(pa.array(some)), pa.array(self.out[some])]


class _Links(_Own):
    """Pairs (own v, partner's larger v) of which rows are within reach."""

    def begin(self) -> None:
        self.lo, self.hi = np.minimum.reduceat(self.v, self.box[0]), np.maximum.reduceat(self.v, self.box[0])

    def add(self, y, v, at, near, far):
        lo, hi = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
        got = []
        for mine, vt, hit in self.compared(y, v, near & (self.lo[:, None] < hi[None, :])):
            a, b = np.argsort(self.v[mine], kind="stable"), np.argsort(vt, kind="stable")
            (ka, ia), (kb, ib) = (np.unique(k, return_index=True) for k in (self.v[mine][a], vt[b]))
            met = np.logical_or.reduceat(np.logical_or.reduceat(hit[a], ia, axis=0)[:, b], ib, axis=1) & (ka[:, None] < kb[None, :])
            r, c = np.nonzero(met)
            got.append(np.stack([ka[r], kb[c]], axis=1))
        if got:
            pairs = np.unique(np.concatenate(got), axis=0)
            return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
        return None

    def result(self):
        return iter(())


def within(own: DataFrame, others: DataFrame, eps: float, axes: list[int], how: str, max_cell_rows: int = 20000) -> DataFrame:
    """What the ``others`` (x, v) within ``eps`` of each ``own`` row (id, x, v)
    come to: ``total`` (id, v: the sum of their v), ``least`` (id, v: the
    smallest one, no row without any), or ``links`` (src, dst: own v and larger v
    of others, repeated at most once a batch). v are long, x finite; a row that
    is in both tables is within reach of itself. Crowded cells are parted by id
    and x together, as many own rows may share one id."""
    kind = {"total": _Total, "least": _Least, "links": _Links}[how]
    limit, side = float(eps) * float(eps), float(eps) * (1 + 1e-6)
    rest = [i for i in range(3) if i not in axes][:1]

    def placed(df: DataFrame, row: Column, *cols: str) -> DataFrame:
        at = [F.col("x")[a] / side for a in axes]
        return df.select(row.alias("id"), "x", F.col("v").cast("long").alias("v"), *cols, F.floor(at[0]).alias("cx"),
                         (F.floor(at[1]) if len(at) > 1 else F.lit(0).cast("long")).alias("cy"),
                         F.floor(at[0] * FINE).alias("f0"), (F.floor(at[1] * FINE) if len(at) > 1 else F.lit(0).cast("long")).alias("f1"),
                         (F.get("x", F.lit(rest[0])) if rest else F.lit(0.0)).cast("double").alias("f2"))

    mine = placed(own, F.col("id"))
    cells = (mine.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(max_cell_rows))).cast("int").alias("salts")))
    mine = mine.join(cells, ["cx", "cy"]).withColumn("salt", F.pmod(F.xxhash64("id", "x"), F.col("salts")).cast("int")).withColumn("side", F.lit(0))
    id_type = own.schema["id"].dataType
    offsets = [(dx, dy) for dx in (-1, 0, 1) for dy in ((-1, 0, 1) if len(axes) > 1 else (0,))]
    # a partner goes to those cells around it that have own rows, once for each part
    around = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in offsets]))
    partners = (placed(others, F.lit(None).cast(id_type)).withColumn("c", around)
                .select("id", "x", "v", "f0", "f1", "f2", "c.cx", "c.cy").join(cells, ["cx", "cy"])
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("side", F.lit(1)))
    names = ["src", "dst"] if how == "links" else ["id", "v"]

    def run(batches):
        here, block = None, None
        for (*cell, part), b in _streams(batches, ["cx", "cy", "salt"]):
            if cell != here:
                if block is not None:
                    for got in block.result():
                        yield pa.RecordBatch.from_arrays(got, names)
                here, block = cell, kind(limit)
            if not part:
                block.hold(b)
            else:
                got = block.meet(b)
                if got is not None:
                    yield pa.RecordBatch.from_arrays(got, names)
        if block is not None:
            for got in block.result():
                yield pa.RecordBatch.from_arrays(got, names)

    cols = ["cx", "cy", "salt", "side", "f0", "f1", "f2", "id", "x", "v"]
    dealt = (mine.select(*cols).unionByName(partners.select(*cols)).repartition("cx", "cy", "salt")
             .sortWithinPartitions("cx", "cy", "salt", "side", "f0", "f1", "f2").drop("f0", "f1", "f2"))
    return dealt.mapInArrow(run, "src long, dst long" if how == "links" else f"id {id_type.simpleString()}, v long")
