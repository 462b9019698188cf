"""Feature engineering: ratio and interaction columns, PCA explained variance
and the centred 2-D projection.

PCA needs only the p x p covariance of the standardised columns: it is
computed in one aggregate (p(p+1)/2 expressions; Gramian blocks for wide
tables), the eigen-decomposition
of that small matrix runs on the driver (bounded by the column count, as in
Spark ML's own PCA), and the projection is a column expression per row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, null_if_nan, numeric_cols, ref
from tessera.operators.gramian import column_moments, moments

#: Columns up to which covariances are one aggregate of expressions; beyond, Gramian blocks.
WIDE = 16


def _check_new_name(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")


def ratio_feature(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """a / (b with 0 as missing + 1e-9). A zero denominator gives NULL; the
    infinite result of b = -1e-9 is also NULL (documented deviation)."""
    name = name or f"{a}_per_{b}"
    _check_new_name(df, name)
    den = F.nullif(ref(b).cast("double"), F.lit(0.0)) + F.lit(1e-9)
    return df.withColumn(name, F.try_divide(ref(a).cast("double"), den))


def interaction_feature(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    name = name or f"{a}_x_{b}"
    _check_new_name(df, name)
    return df.withColumn(name, ref(a).cast("double") * ref(b).cast("double"))


def _standardised_cov(df: DataFrame, cols: list[str], fill_zero: bool) -> tuple[np.ndarray, dict]:
    xs = [null_if_nan(ref(c).cast("double")) for c in cols]
    if fill_zero:
        xs = [F.coalesce(x, F.lit(0.0)) for x in xs]
    if len(cols) > WIDE:
        return np.nan_to_num(column_moments(df, xs).correlation()), {}
    st = collect_row(df, *[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"),
                                    (F.min(x) == F.max(x)).alias("c")).alias(f"c{i}")
                           for i, x in enumerate(xs)])
    zs = []
    for i, x in enumerate(xs):
        s = st[f"c{i}"]
        zs.append(F.lit(0.0) if s["c"] or s["s"] in (None, 0.0) else (x - F.lit(s["m"])) / F.lit(s["s"]))
    p = len(cols)
    cov_row = collect_row(df, *[F.covar_pop(zs[i], zs[j]).alias(f"v{i}_{j}")
                                for i in range(p) for j in range(i, p)])
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = cov_row[f"v{i}_{j}"] or 0.0
    return cov, {"zs": zs, "stats": st}


def pca_explained(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(component, individual %, cumulative %) on standardised, zero-filled columns."""
    cols = cols or numeric_cols(df)
    if len(cols) < 2:
        raise ValueError("PCA needs at least two numeric columns")
    cov, _ = _standardised_cov(df, cols, fill_zero=True)
    ev = np.clip(np.sort(np.linalg.eigvalsh(cov))[::-1], 0.0, None)
    total = ev.sum()
    ind = ev / total * 100.0 if total > 0 else np.zeros_like(ev)
    cum = np.cumsum(ind)
    rows = [(i + 1, float(ind[i]), float(cum[i])) for i in range(len(ev))]
    return df.sparkSession.createDataFrame(rows, "component int, individual_pct double, cumulative_pct double")


def pca_project_2d(x_df: DataFrame, key_cols: list[str], dim: int, x: str = "x") -> DataFrame:
    """Centre, project on the two leading principal axes; each axis is signed so
    that its largest-magnitude loading is positive. A single feature is padded
    with a zero column."""
    xs = [F.col(x)[i] for i in range(dim)]
    if dim > WIDE:
        found = moments(x_df, F.col(x), dim)
        mean, cov = found.means(), found.covariance()
    else:
        got = collect_row(x_df, *[F.avg(v).alias(f"m{i}") for i, v in enumerate(xs)])
        mean = [got[f"m{i}"] for i in range(dim)]
    cs = [v - F.lit(None if m is None else float(m)).cast("double") for v, m in zip(xs, mean, strict=True)]
    if dim == 1:
        return x_df.select(*[ref(k) for k in key_cols], cs[0].alias("pc1"), F.lit(0.0).alias("pc2"))
    if dim <= WIDE:
        cov_row = collect_row(x_df, *[F.covar_pop(cs[i], cs[j]).alias(f"v{i}_{j}")
                                      for i in range(dim) for j in range(i, dim)])
        cov = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                cov[i, j] = cov[j, i] = cov_row[f"v{i}_{j}"] or 0.0
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:2]
    comps = []
    for k in order:
        vec = v[:, k]
        if vec[np.argmax(np.abs(vec))] < 0:
            vec = -vec
        comps.append(vec)
    proj = []
    for vec in comps:
        if dim > WIDE:  # one expression over the array instead of hundreds of terms
            weights, shift = (F.array(*[F.lit(float(v)) for v in a]) for a in (vec, mean))
            terms = F.zip_with(F.zip_with(F.col(x), shift, lambda u, m: u - m), weights, lambda u, w: u * w)
            proj.append(F.aggregate(terms, F.lit(0.0), lambda t, u: t + u))
            continue
        e = None
        for i in range(dim):
            term = cs[i] * F.lit(float(vec[i]))
            e = term if e is None else e + term
        proj.append(e)
    return x_df.select(*[ref(k) for k in key_cols], proj[0].alias("pc1"), proj[1].alias("pc2"))
