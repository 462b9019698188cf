"""Second moments of any number of columns in one scan.

Each task adds up four matrices over its rows: how often two columns are both
present, and on those rows the sums, sums of squares and products. They are
matrix products of the batch with its mask, so a table with hundreds of
columns and gaps anywhere costs one pass; the partial matrices are added up
by Spark. Values are shifted by the mean of a few first rows, so that a large
offset does not eat the digits; the shift changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT_ROWS = 200
#: A variance below this share of the mean square (about the shift) is rounding: the column is constant.
NO_VARIANCE = 1e-13


@dataclass(frozen=True)
class Moments:
    """``n[i, j]``: rows in which columns i and j are present; on these, about
    ``shift``, the sums ``s[i, j]`` and sums of squares ``q[i, j]`` of column i
    and the products ``p[i, j]``."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    p: np.ndarray
    shift: np.ndarray

    def means(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.shift + np.diag(self.s) / np.diag(self.n)

    def covariance(self) -> np.ndarray:
        """Population covariance on pairwise complete rows; NaN without such rows."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.p / self.n - (self.s / self.n) * (self.s.T / self.n)

    def _variances(self) -> np.ndarray:
        """[i, j]: variance of column i on the rows in which j is present too, 0 if constant there."""
        with np.errstate(divide="ignore", invalid="ignore"):
            square = self.q / self.n
            var = square - (self.s / self.n) ** 2
            return np.where(var <= NO_VARIANCE * square, 0.0, var)

    def correlation(self) -> np.ndarray:
        """Pearson r on pairwise complete rows; NaN where a column is constant or absent."""
        var = self._variances()
        scale = np.sqrt(var * var.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale > 0, self.covariance() / scale, np.nan)


def moments(df: DataFrame, values: Column, width: int) -> Moments:
    """Moments of ``values``, an array of ``width`` doubles a row (null and NaN: missing)."""
    rows = df.select(F.transform(values, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("v")).where("v is not null")
    first = np.array([r["v"] for r in rows.limit(SHIFT_ROWS).collect()], float).reshape(-1, width)
    seen = np.isfinite(first)
    shift = np.where(seen, first, 0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1)

    def run(batches):
        n, s, q, p = (np.zeros((width, width)) for _ in range(4))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            m = ~np.isnan(x)
            z, m = np.where(m, x - shift, 0.0), m.astype(float)
            n += m.T @ m
            s += z.T @ m
            q += (z * z).T @ m
            p += z.T @ z
        flat = np.concatenate([n, s, q, p], axis=1)
        off = pa.array(np.arange(0, (width + 1) * 4 * width, 4 * width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.ListArray.from_arrays(off, pa.array(flat.ravel()))], ["i", "row"])

    parts = rows.mapInArrow(run, "i int, row array<double>").select("i", array_to_vector("row").alias("row"))
    found = parts.groupBy("i").agg(Summarizer.sum(F.col("row")).alias("row")).collect()  # width rows
    total = np.zeros((width, 4 * width))
    for r in found:
        total[r["i"]] = r["row"].toArray()
    return Moments(*np.hsplit(total, 4), shift)


def column_moments(df: DataFrame, columns: list[Column]) -> Moments:
    return moments(df, F.array(*[c.cast("double") for c in columns]), len(columns))
