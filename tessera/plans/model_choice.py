"""How many clusters: the gap statistic, and stability under other seeds.

The gap statistic compares log W_k (W_k: sum of squared distances to the
nearest of k centres) with its mean over reference tables, uniform in the
bounding box of the data. The references are drawn on the executors from a
seeded generator, as large as the data; nothing of them is collected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row
from tessera.operators.agreement import agreement
from tessera.operators.kmeans import assign, kmeans_fit
from tessera.operators.pairs import vector_dim


def reference(df: DataFrame, seed: int, x: str = "x") -> DataFrame:
    """``(id, x)``: as many rows as ``df``, uniform in its bounding box; the
    same rows for the same seed, whatever the cluster."""
    dim = vector_dim(df, x)
    row = collect_row(df, F.count(F.lit(1)).alias("n"), *[f(F.col(x)[i]).alias(f"{a}{i}") for i in range(dim) for a, f in (("l", F.min), ("h", F.max))])
    unit = (1 << 53) - 1
    def drawn(i: int):
        u = F.xxhash64(F.lit(seed), F.lit(i), "id").bitwiseAND(unit) / F.lit(float(unit))
        return F.lit(float(row[f"l{i}"])) + u * F.lit(float(row[f"h{i}"] - row[f"l{i}"]))
    return df.sparkSession.range(row["n"]).select("id", F.array(*[drawn(i) for i in range(dim)]).alias("x"))


def _log_w(df: DataFrame, key: str, ks: list[int], seed: int) -> list[float]:
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    dim = vector_dim(data)
    for k in ks:
        if k == 1:  # the squares about the mean of all
            row = collect_row(data, F.count(F.lit(1)).alias("n"), *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(dim)])
            w = row["n"] * sum(row[f"v{i}"] for i in range(dim))
        else:
            w = kmeans_fit(data, key, k, seed=seed, canonical=False).inertia
        out.append(math.log(w) if w > 0 else -math.inf)
    data.unpersist()
    return out


def gap_statistic(df: DataFrame, key: str, max_k: int = 8, references: int = 5, seed: int = 42, x: str = "x") -> DataFrame:
    """``(k, log_w, reference_log_w, gap, s, chosen)`` for k = 1 .. max_k.
    ``s`` is the standard error of the reference times sqrt(1 + 1/references);
    chosen is the smallest k with gap(k) >= gap(k + 1) - s(k + 1)."""
    ks = list(range(1, max_k + 1))
    rows = df.select(key, F.col(x).alias("x"))
    mine = _log_w(rows, key, ks, seed)
    theirs = np.array([_log_w(reference(rows, seed + b), "id", ks, seed + b) for b in range(references)])
    mean, s = theirs.mean(axis=0), theirs.std(axis=0) * math.sqrt(1 + 1 / references)
    gap = mean - np.array(mine)
    good = [i for i in range(len(ks) - 1) if gap[i] >= gap[i + 1] - s[i + 1]]
    best = good[0] if good else len(ks) - 1
    out = [(k, mine[i], float(mean[i]), float(gap[i]), float(s[i]), i == best) for i, k in enumerate(ks)]
    return df.sparkSession.createDataFrame(out, "k int, log_w double, reference_log_w double, gap double, s double, chosen boolean")


def seed_stability(df: DataFrame, key: str, ks: list[int], seeds: int = 5, x: str = "x") -> DataFrame:
    """``(k, mean_ari, min_ari)``: agreement of the labellings that differently
    seeded k-means runs give, over all pairs of runs. A k whose clusters are
    real gives the same ones every time."""
    rows = df.select(key, F.col(x).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for k in ks:
        runs = [assign(rows, kmeans_fit(rows, key, k, seed=1000 + s, canonical=False).centres).select(key, "cluster") for s in range(seeds)]
        got = [agreement(runs[i], runs[j], [key]).first()["ari"] for i in range(seeds) for j in range(i + 1, seeds)]
        out.append((k, float(np.mean(got)), float(min(got))))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, mean_ari double, min_ari double")
