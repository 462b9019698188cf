"""Agglomerative clustering (ward, complete, average, single) and the merge
table (dendrogram), on all rows at any size.

Ward, complete and average linkage are reducible, so greedy closest-pair
merging gives the same tree as merging all reciprocal nearest neighbours at
once. A round deals the clusters into boxes of space, and a task merges what
can be decided in its box (`merge_boxes`); the number of rounds is about
logarithmic. Where boxes decide too little, a round finds every cluster's nearest
cluster and merges the reciprocal pairs. Distances are then computed in blocks: rows are dealt into blocks by their cluster, those of a
cluster larger than a block over all blocks; a task holds one pair of blocks,
reduces its distances to one value per pair of clusters (ward: from sizes and
centroids; complete and average: maximum and sum over the members) and returns
each cluster's nearest only, so no pair is written out but those with a large
cluster, whose parts are combined in Spark. When at most ``finish`` clusters are left, their distance
matrix (``finish`` squared values) is put together from the same blocks and
one task of that bounded size merges the rest with Lance-Williams updates;
where the rounds stop changes the work, not the tree. Rows with equal vectors
merge first, at height 0 and in the order of their keys: those merges are
written down at once, and the rounds begin with one weighted point a vector.

Single linkage needs no cluster distances: its tree is the minimum spanning
tree, by Boruvka rounds (every component takes its shortest edge to another).

A merge is stored as the smallest keys of its two parts, height and size. A
cut at k leaves out the k - 1 last merges and takes connected components of
the others, so any number of rows can be cut. At equal distances the pair of
smaller keys merges first. The work is quadratic in the rows, as the linkage
definitions are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import join_shared
from tessera.operators import merge_boxes
from tessera.operators.graph import connected_components, dense_index
from tessera.operators.pairs import eps_join, vector_dim
from tessera.session import Scratch, ensure_checkpoint_dir

LINKAGES = ("ward", "complete", "average", "single")
FINISH = 3000
BLOCK = 2000
TASK_BLOCKS = 32  # blocks of rows a task holds at most
STALLED = 0.02  # after a round in boxes that merges a smaller share of the clusters the boxes are larger
MERGE = "left long, right long, height double, size long"


# ----------------------------------------------------- distances in blocks

def _between(a: pd.DataFrame, b: pd.DataFrame, linkage: str) -> np.ndarray:
    """Ward distance, or maximum / sum of the members' distances, of a's
    clusters (rows) to b's (columns); both sorted by cluster. A point counts
    ``w`` times in a sum."""
    xa, xb = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
    wa, wb = a["w"].to_numpy(float), b["w"].to_numpy(float)
    if linkage == "ward":
        return merge_boxes.ward(xa, wa, xb, wb)
    ca, cb = a["c"].to_numpy(), b["c"].to_numpy()
    rows, cols = np.flatnonzero(np.append(True, ca[1:] != ca[:-1])), np.flatnonzero(np.append(True, cb[1:] != cb[:-1]))
    return merge_boxes.reduced(xa, wa, rows, xb, wb, cols, linkage)


def _large(points: DataFrame, linkage: str, block: int) -> DataFrame | None:
    """Clusters (c) of more than ``block`` rows, fewer than rows / block; None
    if there are none. Ward keeps one row a cluster."""
    if linkage == "ward":
        return None
    large = points.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("c", F.lit(True).alias("large")).checkpoint(eager=True)
    return None if large.isEmpty() else large


def _blocked(points: DataFrame, parts: int, large: DataFrame | None) -> DataFrame:
    """points (c, w, x) as pairs of blocks (i <= j): a cluster's rows together,
    those of large clusters dealt over all blocks."""
    mine = F.pmod(F.xxhash64("c"), F.lit(parts))
    if large is not None:
        points = points.join(F.broadcast(large), "c", "left").withColumn("large", F.coalesce("large", F.lit(False)))
        mine = F.when(F.col("large"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(mine)
    else:
        points = points.withColumn("large", F.lit(False))
    return (points.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other"))


def _sides(pdf: pd.DataFrame, linkage: str):
    """One pair of blocks: clusters of i and of j, their distances (raw maxima
    or sums; inf to itself), row counts and whether they are large."""
    pdf = pdf.sort_values("c", kind="stable")
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    a, b = pdf[pdf["mine"] == i], pdf[pdf["mine"] == j]
    if a.empty or b.empty:
        return None
    d = _between(a, b, linkage)
    ga, gb = (s.groupby("c").agg(w=("w", "sum"), large=("large", "first")) for s in (a, b))
    ka, kb = ga.index.to_numpy(), gb.index.to_numpy()
    d = np.where(ka[:, None] == kb[None, :], np.inf, d)
    return (ka, kb, d, ga["w"].to_numpy(float), gb["w"].to_numpy(float), ga["large"].to_numpy(bool)[:, None] | gb["large"].to_numpy(bool)[None, :], i == j)


_PAIRS = "c long, nb long, d double, part boolean"


def _rows(c, nb, d, part: bool) -> pd.DataFrame:
    return pd.DataFrame({"c": np.asarray(c, np.int64), "nb": np.asarray(nb, np.int64), "d": np.asarray(d, float), "part": part})


def _parts(ka, kb, d, wanted, same: bool) -> pd.DataFrame:
    """The entries ``wanted`` once each, smaller cluster first."""
    take = wanted & np.isfinite(d) & ((ka[:, None] < kb[None, :]) if same else True)
    r, q = np.nonzero(take)
    return _rows(np.minimum(ka[r], kb[q]), np.maximum(ka[r], kb[q]), d[r, q], True)


def _combined(parts: DataFrame, points: DataFrame, linkage: str) -> DataFrame:
    """``(c, nb, d)`` from the parts of each pair of clusters (c < nb)."""
    if linkage == "complete":
        return parts.groupBy("c", "nb").agg(F.max("d").alias("d"))
    whole = parts.groupBy("c", "nb").agg(F.sum("d").alias("d"))
    w = points.groupBy("c").agg(F.sum("w").alias("w"))
    return (whole.join(w, "c").join(w.select(F.col("c").alias("nb"), F.col("w").alias("wb")), "nb")
            .select("c", "nb", (F.col("d") / (F.col("w").cast("double") * F.col("wb").cast("double"))).alias("d")))


def _nearest(points: DataFrame, parts: int, linkage: str, block: int) -> DataFrame:
    """(c, d, nb): the nearest other cluster, the smaller id at equal distance.
    Between clusters that are each in one block the task decides; with a large
    one it returns its part of the distance, and the parts are combined."""
    large = _large(points, linkage, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _sides(pdf, linkage)
        if got is None:
            return _rows([], [], [], False)
        ka, kb, d, wa, wb, split, same = got
        out = [_parts(ka, kb, d, split, same)] if split.any() else []
        if linkage == "average":
            d = d / (wa[:, None] * wb[None, :])
        d = np.where(split, np.inf, d)
        for keys, others, m in ((ka, kb, d), (kb, ka, d.T)):
            at = m.argmin(axis=1)  # first at ties, and the others are sorted
            best = m[np.arange(len(keys)), at]
            ok = np.isfinite(best)
            out.append(_rows(keys[ok], others[at[ok]], best[ok], False))
        return pd.concat(out, ignore_index=True)

    near = _blocked(points, parts, large).groupBy("i", "j").applyInPandas(run, _PAIRS)
    if large is not None:
        near = near.checkpoint(eager=True)
        whole = _combined(near.where("part").drop("part"), points, linkage)
        near = near.where("not part").select("c", "nb", "d").unionByName(whole).unionByName(whole.select(F.col("nb").alias("c"), F.col("c").alias("nb"), "d"))
    return near.groupBy("c").agg(F.min(F.struct("d", "nb")).alias("m")).select("c", "m.d", "m.nb")


# ------------------------------------------------------------------ finish

def lance_williams(d: np.ndarray, w: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of clusters with distances ``d`` (inf on the
    diagonal) and sizes ``w``; slot a holds the merged cluster afterwards."""
    d, w, alive = d.copy(), w.astype(float).copy(), np.ones(len(w), bool)
    nearest = d.argmin(axis=1) if len(w) > 1 else np.zeros(len(w), int)
    out = []
    for _ in range(len(w) - 1):
        slots = np.flatnonzero(alive)
        a = slots[d[slots, nearest[slots]].argmin()]
        b = nearest[a]
        a, b = min(a, b), max(a, b)
        h = d[a, b]
        out.append((int(a), int(b), float(h)))
        rest = alive.copy()
        rest[[a, b]] = False
        if linkage == "ward":
            new = np.sqrt(np.maximum(((w[a] + w) * d[a] ** 2 + (w[b] + w) * d[b] ** 2 - w * h * h) / (w[a] + w[b] + w), 0))
        elif linkage == "complete":
            new = np.maximum(d[a], d[b])
        else:
            new = (w[a] * d[a] + w[b] * d[b]) / (w[a] + w[b])
        d[a], d[:, a] = np.where(rest, new, np.inf), np.where(rest, new, np.inf)
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
        w[a] += w[b]
        stale = rest & ((nearest == a) | (nearest == b))
        stale[a] = True
        nearest[stale] = d[stale].argmin(axis=1)
        better = rest & ~stale & (d[:, a] < d[np.arange(len(w)), nearest])
        nearest[better] = a
    return out


def _finish(points: DataFrame, parts: int, linkage: str, block: int) -> DataFrame:
    """Merges of the last clusters: block distances to one matrix in one task."""
    large = _large(points, linkage, block)

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _sides(pdf, linkage)
        if got is None:
            return _rows([], [], [], True)
        ka, kb, d, _, _, _, same = got
        return _parts(ka, kb, d, np.ones(d.shape, bool), same)

    # a task for each pair of blocks: the longest work of all
    number = (F.col("j") * (F.col("j") + 1) / 2).cast("int") + F.col("i")
    dealt = merge_boxes.by_number(_blocked(points, parts, large).withColumn("pair", number), "pair", parts * (parts + 1) // 2)

    def one(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_pandas(matrix(pa.Table.from_batches(got).to_pandas()), preserve_index=False)

    pairs = dealt.mapInArrow(one, _PAIRS).drop("part")
    if linkage != "ward":
        pairs = _combined(pairs, points, linkage)
    pairs = pairs.select(F.col("c").alias("a"), F.col("nb").alias("b"), "d")
    sizes = points.groupBy("c").agg(F.sum("w").alias("d")).select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("d").cast("double"))

    def merge(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        a, b, d = (np.concatenate([g.column(c).to_numpy() for g in got]) for c in ("a", "b", "d"))
        own = a == b
        order = np.argsort(a[own])
        keys, w = a[own][order], d[own][order]
        m = np.full((len(keys), len(keys)), np.inf)
        x, y = np.searchsorted(keys, a[~own]), np.searchsorted(keys, b[~own])
        m[x, y], m[y, x] = d[~own], d[~own]
        total = w.copy()
        rows = []
        for p, q, h in lance_williams(m, w, linkage):
            total[p] += total[q]
            rows.append((int(keys[p]), int(keys[q]), h, int(total[p])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows, strict=True))], ["left", "right", "height", "size"])

    # finish squared values at most: bounded by the parameter
    return pairs.union(sizes).repartition(1).mapInArrow(merge, MERGE)


# --------------------------------------------------------------------- tree

def merge_table(df: DataFrame, key: str, linkage: str = "ward", x: str = "x", finish: int = FINISH,
                block: int = BLOCK) -> DataFrame:
    """All merges (left, right, height, size); left and right are the smallest
    keys of the parts."""
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}")
    scratch = Scratch(df.sparkSession, "merges")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(x).alias("x")).checkpoint(eager=True)
    n = rows.count()
    if linkage == "single":
        return _spanning_tree(rows, n, block)
    points, found = _collapsed(rows, n, scratch)
    left = size = points.count()
    step, held, boxed, coarse, dim = 0, "points", True, 1, vector_dim(points) if left else 0
    while left > finish:
        step += 1
        if boxed:  # every task merges what can be decided in its box
            cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
            least = -(-size // (TASK_BLOCKS * block))
            parts = max(least, min(2 * cores, -(-4 * left // block)) // coarse)
            got = scratch.keep(merge_boxes.box_merges(points, dim, left, parts, linkage, block, step), f"merged{step}")
            merged = got.where("merge").drop("merge")
            to = got.where("not merge").select(F.col("right").alias("c"), F.col("left").alias("to"))
        else:
            near = scratch.keep(_nearest(points, -(-size // block), linkage, block), f"near{step}")
            back = near.select(F.col("c").alias("nb"), F.col("nb").alias("c"))
            pairs = near.where("c < nb").join(back, ["c", "nb"]).select("c", "nb", "d")
            weights = points.groupBy("c").agg(F.sum("w").alias("w"))
            merged = (pairs.join(weights, "c").join(weights.select(F.col("c").alias("nb"), F.col("w").alias("wb")), "nb")
                      .select(F.col("c").alias("left"), F.col("nb").alias("right"), F.col("d").alias("height"), (F.col("w") + F.col("wb")).alias("size")))
            merged = scratch.keep(merged, f"merged{step}")
            scratch.drop(f"near{step}")
            to = merged.select(F.col("right").alias("c"), F.col("left").alias("to"))
        gone = merged.count()
        if not gone and not boxed:  # rows with one key are one cluster from the start
            break
        if boxed and gone < STALLED * left:  # larger boxes decide more, and cost more
            boxed, coarse = parts > least, 2 * coarse
        if gone:
            moved = points.join(to, "c", "left").select(F.coalesce("to", "c").alias("c"), "w", "x")
            if linkage == "ward":  # one weighted centroid a cluster
                total = F.sum("w")
                moved = moved.groupBy("c").agg(total.alias("w"), F.array(*[F.when(F.count(F.lit(1)) == 1, F.first(F.col("x")[i])).otherwise(
                    F.sum(F.col("x")[i] * F.col("w")) / total) for i in range(dim)]).alias("x"))
            points = scratch.keep(moved, f"points{step}")
            scratch.drop(held)
            held = f"points{step}"
        left -= gone
        size = left if linkage == "ward" else size
        found = merged if found is None else found.union(merged)
    # at most ``finish`` clusters: larger blocks, as only values per pair of clusters are held
    rows = max(block, min(TASK_BLOCKS * block, -(-size // 6)))
    rest = _finish(points, max(1, -(-size // rows)), linkage, rows)
    whole = (rest if found is None else found.union(rest)).checkpoint(eager=True)
    scratch.drop()
    return whole


def _collapsed(rows: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Points (c, w, x), one a vector, named by its smallest key; and the
    merges that put its rows together, each row to those with smaller keys
    (None if no vector comes twice, or keys are null or come twice)."""
    seen = rows.agg(F.count_distinct(F.xxhash64("x")).alias("x"), F.count_distinct("id").alias("id")).first()
    if seen["x"] == n or seen["id"] < n:
        return scratch.keep(rows.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("w"), "x"), "points"), None
    ranked = scratch.keep(dense_index(rows.select(F.struct("x", "id").alias("m")), "m", out="g").select("m.id", "m.x", "g"), "ranked")
    first = scratch.keep(ranked.groupBy("x").agg(F.min("id").alias("c"), F.min("g").alias("g0"), F.count(F.lit(1)).alias("w")), "first")
    same = join_shared(ranked, first.select("x", "c", "g0"), ["x"]).where("id <> c").select(
        F.col("c").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("height"), (F.col("g") - F.col("g0") + 1).alias("size"))
    return scratch.keep(first.select("c", "w", "x"), "points"), scratch.keep(same, "same")


def _spanning_tree(rows: DataFrame, n: int, block: int) -> DataFrame:
    """Minimum spanning tree by Boruvka rounds."""
    points = rows.select(F.col("id").alias("c"), F.col("id"), F.lit(1).cast("long").alias("w"), "x")
    parts, edges, left, step, scratch = max(1, -(-n // block)), None, n, 0, Scratch(rows.sparkSession, "spanning")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values("id", kind="stable")
        a, b = pdf[pdf["mine"] == i], pdf[pdf["mine"] == j]
        out = []
        if not a.empty and not b.empty:
            d = merge_boxes.distances(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()))
            d[a["c"].to_numpy()[:, None] == b["c"].to_numpy()[None, :]] = np.inf
            for p, q, m in ((a, b, d), (b, a, d.T)):
                at = m.argmin(axis=1)
                best = m[np.arange(len(p)), at]
                ok = np.isfinite(best)
                one, two = p["id"].to_numpy()[ok], q["id"].to_numpy()[at[ok]]
                out.append(pd.DataFrame({"c": p["c"].to_numpy()[ok], "d": best[ok], "u": np.minimum(one, two), "v": np.maximum(one, two)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"c": [], "d": [], "u": [], "v": []}).astype(
            {"c": "int64", "u": "int64", "v": "int64"})

    while left > 1:
        mine = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        dealt = (points.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                 .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other"))
        new = (dealt.groupBy("i", "j").applyInPandas(run, "c long, d double, u long, v long")
               .groupBy("c").agg(F.min(F.struct("d", "u", "v")).alias("m")).select("m.*").distinct())
        step += 1
        edges = scratch.keep((new if edges is None else edges.union(new)).distinct(), f"edges{step}")
        labels = connected_components(rows.select("id"), edges.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        points = scratch.keep(points.drop("c").join(labels, "id").select(F.col("root").alias("c"), "id", "w", "x"), f"points{step}")
        if step > 1:
            scratch.drop(f"edges{step - 1}")
            scratch.drop(f"points{step - 1}")
        left = points.select("c").distinct().count()
    none = rows.sparkSession.createDataFrame([], MERGE)
    # the size of a part of the spanning tree is not known here: 0
    return none if edges is None else edges.select(F.col("u").alias("left"), F.col("v").alias("right"), F.col("d").alias("height"), F.lit(0).cast("long").alias("size"))


def cut(df: DataFrame, key: str, merges: DataFrame, k: int) -> DataFrame:
    """(key, cluster): the parts without the k - 1 last merges, numbered by
    their smallest key."""
    ids = df.select(F.col(key).cast("long").alias("id"))
    n = ids.count()
    if n < k:
        raise ValueError(f"{n} rows cannot form {k} clusters")
    last = merges.orderBy(F.desc("height"), F.desc("size"), F.desc("left"), F.desc("right")).limit(k - 1)
    links = merges.join(last.select("left", "right"), ["left", "right"], "left_anti") if k > 1 else merges
    roots = connected_components(ids, links.select(F.col("left").alias("src"), F.col("right").alias("dst")))
    first = roots.select("root").distinct()  # k rows
    numbered = first.select("root", (F.row_number().over(Window.orderBy("root")) - 1).cast("int").alias("cluster"))
    return roots.join(numbered, "root").select(F.col("id").alias(key), "cluster")


def agglomerative_cuts(df: DataFrame, key: str, ks: list[int], linkage: str = "ward", x: str = "x") -> DataFrame:
    """(n_clusters, key, cluster) for several cluster counts from one merge tree."""
    merges = merge_table(df, key, linkage, x)
    out = None
    for k in ks:
        one = cut(df, key, merges, k).select(F.lit(k).alias("n_clusters"), key, "cluster")
        out = one if out is None else out.unionByName(one)
    return out


def agglomerative(df: DataFrame, key: str, k: int = 3, linkage: str = "ward", x: str = "x",
                  finish: int = FINISH, block: int = BLOCK) -> DataFrame:
    return cut(df, key, merge_table(df, key, linkage, x, finish, block), k)


def dendrogram(df: DataFrame, key: str, linkage: str = "ward", x: str = "x") -> DataFrame:
    """Merge table in merge order: (step, left, right, height, size); the steps
    are numbered by the distributed rank."""
    merges = merge_table(df, key, linkage, x)
    order = merges.select(F.struct("height", "size", "left", "right").alias("m"))
    return (dense_index(order, "m", out="step")
            .select(F.col("step").cast("int").alias("step"), "m.left", "m.right", "m.height", F.col("m.size").cast("double").alias("size")))


# ----------------------------------------------------- single linkage, exact

def single_linkage_at(df: DataFrame, key: str, height: float, x: str = "x") -> DataFrame:
    """Single-linkage clusters cut at ``height``: connected components of the
    graph joining rows at distance <= height. Numbered by smallest key."""
    pts = df.select(F.col(key).alias("id"), F.col(x).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    pairs = eps_join(pts, height).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    comps = connected_components(pts.select("id"), pairs, vid="id")
    numbered = dense_index(comps, "root", out="cluster")
    return comps.join(numbered, "root").select(F.col("id").alias(key), F.col("cluster").cast("int").alias("cluster"))
