"""Embedding near-duplicates by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard
transform and takes the coordinate of largest magnitude with its sign. A
table's bucket is ``hashes`` of them; besides its own bucket a vector is put
into ``probes - 1`` neighbouring buckets, where the hash with the closest
decision takes its runner-up coordinate. Vectors that meet in a bucket are
candidates, and every candidate pair is verified by its cosine in double
precision. ``hashes`` follows the number of vectors (buckets keep a bounded
expected size), ``probes`` and ``tables`` follow ``hashes`` for the recall
(``tests/llm`` measures it against brute force).

Equal vectors are first collapsed into one weighted class. A bucket is
compared in blocks of ``BLOCK`` members: a larger bucket is dealt out as
pairs of blocks, so no task holds more than two blocks. Pairs are not
written out: a block pair returns per vector the number of links, a pair
counted only in the smallest bucket both share, and at most one edge per
vector for the components.

Defined cases: null, empty or zero vectors and those with null or non-finite
components link with nothing, and vectors link only with vectors of their
length; rows with a null id are not compared (no links, null component, not
kept); rows that share an id are one vertex, and each row counts as a vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.common import materialize, sorted_groups, table
from tessera.operators.graph import connected_components

BLOCK = 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def buckets(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """(rows, tables * probes) bucket keys of unit vectors, own bucket first in each table."""
    n, dim = unit.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = unit
    rng = np.random.default_rng([seed, dim])
    keys = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice([-1.0, 1.0], d))
            size = np.abs(x)
            top = np.argpartition(size, d - 2, axis=1)[:, d - 2:]
            order = size[rows[:, None], top]
            first = np.where(order[:, 0] > order[:, 1], 0, 1)
            i, j = top[rows, first], top[rows, 1 - first]
            best.append(2 * i + (x[rows, i] < 0))
            second.append(2 * j + (x[rows, j] < 0))
            gap.append((size[rows, i] - size[rows, j]) / np.maximum(size[rows, i], 1e-300))
        code = np.zeros(n, np.int64)
        for b in best:
            code = code * (2 * d) + b
        keys[:, t, 0] = code
        closest = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")
        for p in range(1, probes):
            swap = closest[:, (p - 1) % hashes]
            code = np.zeros(n, np.int64)
            for k in range(hashes):
                code = code * (2 * d) + np.where(swap == k, second[k], best[k])
            keys[:, t, p] = code
        # table and code in 47 bits (hashed where they need more), the length in the 16 below: lengths never mix
        keys[:, t, :] = _folded(keys[:, t, :], t, hashes * (2 * d).bit_length())
    return (keys << 16 | (dim & 0xFFFF)).reshape(n, tables * probes)


def _folded(code: np.ndarray, t: int, bits: int) -> np.ndarray:
    if bits + 8 <= 47 and t < 256:
        return code | t << bits
    mixed = words.mix(code.view(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (mixed >> np.uint64(17)).view(np.int64)


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hash_rows(tables: int, hashes: int, probes: int):
    def run(batches):
        for b in batches:
            length = b.column("d").to_numpy()
            for d in np.unique(length):
                part = b.filter(pa.array(length == d))
                keys = buckets(_unit(_matrix(part.column("v"))), tables, hashes, probes)
                m = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("h"), part.column("w"), part.column("v"),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * m), pa.array(keys.ravel()))],
                    ["rep", "h", "w", "v", "buckets"])
    return run


def _compare(threshold: float, tables: int, probes: int):
    """Links within each (bucket, block pair): counts and edges to the first vector
    of each local component."""
    def first_shared(ka, kb, key):
        a, b = ka.reshape(-1, tables, probes), kb.reshape(-1, tables, probes)
        low = np.full(len(a), np.iinfo(np.int64).max)
        for p in range(probes):
            for q in range(probes):
                same = a[:, :, p] == b[:, :, q]
                low = np.minimum(low, np.where(same, a[:, :, p], np.iinfo(np.int64).max).min(axis=1))
        return low == key

    def run(batches):
        for g in sorted_groups(batches, ["bucket", "i", "j"]):
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            key = g.column("bucket")[0].as_py()
            side = g.column("block").to_numpy()
            rep, h, w = (g.column(c).to_numpy() for c in ("rep", "h", "w"))
            unit, keys = _unit(_matrix(g.column("v"))), _matrix(g.column("buckets"))
            ia = np.flatnonzero(side == i)
            ib = np.flatnonzero(side == j)
            count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
            for lo in range(0, len(ia), 256):
                rows = ia[lo: lo + 256]
                a, b = np.nonzero(unit[rows] @ unit[ib].T >= threshold)
                a, b = rows[a], ib[b]
                if i == j:
                    once = (rep[a] < rep[b]) | ((rep[a] == rep[b]) & (h[a] < h[b]))
                    a, b = a[once], b[once]
                for s in range(0, len(a), 1 << 16):
                    x, y = a[s: s + (1 << 16)], b[s: s + (1 << 16)]
                    new = first_shared(keys[x], keys[y], key)
                    np.add.at(count, x[new], w[y[new]])
                    np.add.at(count, y[new], w[x[new]])
                _merge(root, a, b)
            hit, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
            if len(hit) or len(tied):
                e = np.stack([rep[tied], rep[root[tied]]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rep[hit], e[:, 0]])),
                     pa.array(np.concatenate([h[hit], np.zeros(len(e), np.int64)])),
                     pa.array(np.concatenate([count[hit], np.zeros(len(e), np.int64)])),
                     pa.array([None] * len(hit) + e[:, 1].tolist(), pa.int64())],
                    ["rep", "h", "n", "dst"])
    return run


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all rows that the links (a, b) connect the smallest root among them."""
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                 hashes: int | None = None, tables: int | None = None, probes: int | None = None,
                 block: int = BLOCK) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    src = src.select("id", F.when(F.coalesce(ok, F.lit(False)) & F.col("id").isNotNull(), F.col("v")).alias("v"))
    src = src.select("id", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("h2"))
    classes = materialize(src.where("v is not null").groupBy("h", "h2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")), "vectors")
    n = classes.count()
    if n == 0:
        return vectors.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"),
                              F.col(id_col).cast("long").alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    dim = classes.agg(F.max(F.size("v"))).first()[0]
    if hashes is None:
        hashes = max(1, round(math.log(n) / math.log(2 * dim)))
    if probes is None:
        probes = max(2, hashes)
    if tables is None:
        tables = 3 + 3 * 2 ** (hashes - 1)
    fields = f"rep long, h long, w long, v {dict(classes.dtypes)['v']}, buckets array<long>"
    hashed = materialize(classes.select("rep", "h", "w", "v", F.size("v").alias("d"))
                         .mapInArrow(_hash_rows(tables, hashes, probes), fields), "hashed")
    member = hashed.select("rep", "h", F.explode(F.array_distinct("buckets")).alias("bucket"))
    crowd = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    placed = (hashed.withColumn("bucket", F.explode(F.array_distinct("buckets"))).join(crowd, "bucket")
              .withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "h"), F.col("n")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "rep", "h", "w", "v", "buckets"))
    found = materialize(placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
                        .mapInArrow(_compare(threshold, tables, probes), "rep long, h long, n long, dst long"), "links")
    counts = found.where("dst is null").groupBy("rep", "h").agg(F.sum("n").alias("n"))
    links = found.where("dst is not null").select(F.col("rep").alias("src"), "dst")
    # ids that stand for several vectors are one vertex
    split = src.where("v is not null").join(classes.select("h", "h2", "rep"), ["h", "h2"]).where("rep <> id")
    several = src.where("v is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    links = links.union(split.join(several, "id", "left_semi").select(F.col("rep").alias("src"), F.col("id").alias("dst")))
    roots = connected_components(classes.select(F.col("rep").alias("id")).distinct(), links)
    per_class = (classes.select("h", "h2", "rep", "w").join(counts, ["rep", "h"], "left")
                 .join(roots.select(F.col("id").alias("rep"), "root"), "rep")
                 .select("h", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "root"))
    return (src.withColumn("h", F.when(F.col("v").isNotNull(), F.col("h"))).join(per_class, ["h", "h2"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).isNotNull() & (F.col(id_col) == F.col("component_id"))))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
