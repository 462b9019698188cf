"""One-way analysis of variance: which features tell the clusters apart.

One aggregate per cluster gives count, mean and variance of every feature;
F and its p-value come from those few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import nan_as_missing, numeric_cols, ref


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def f_tail(f: float, between: int, within: int) -> float:
    """Probability of a value of at least ``f`` under the F distribution."""
    return incomplete_beta(within / 2, between / 2, within / (within + between * f))


def anova(labelled: DataFrame, key_cols: list[str], cluster: str = "cluster", noise: bool = False) -> DataFrame:
    """``(feature, clusters, rows, f, p)`` for every numeric feature, missing
    values left out; noise (-1) counts only if asked for. Null where fewer than
    two clusters or no spare rows are left; a feature without variance inside
    the clusters has f infinite (p 0) if their means differ, else null."""
    df = nan_as_missing(labelled)
    feats = numeric_cols(df, [*key_cols, cluster])
    df = df.where(ref(cluster).isNotNull() if noise else ref(cluster) >= 0)
    x = [ref(c).cast("double") for c in feats]
    rows = df.groupBy(cluster).agg(*[F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v")).alias(f"c{i}")
                                     for i, v in enumerate(x)]).collect()  # a row a cluster
    out = []
    for i, name in enumerate(feats):
        s = [r[f"c{i}"] for r in rows if r[f"c{i}"]["n"]]
        n, k = sum(g["n"] for g in s), len(s)
        f = p = None
        if k > 1 and n > k:
            mean = math.fsum(g["n"] * g["m"] for g in s) / n
            between = math.fsum(g["n"] * (g["m"] - mean) ** 2 for g in s) / (k - 1)
            within = math.fsum(g["n"] * g["v"] for g in s) / (n - k)
            if within > 0:
                f = between / within
                p = f_tail(f, k - 1, n - k)
            elif between > 0:
                f, p = math.inf, 0.0
        out.append((name, k, n, f, p))
    return df.sparkSession.createDataFrame(out, "feature string, clusters long, rows long, f double, p double")
