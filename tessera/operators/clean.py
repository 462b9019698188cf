"""Cleaning: imputation, categorical fill, dropping incomplete rows, and
outlier handling (z-score removal, IQR removal, percentile clipping).

Each step computes all of its statistics in one aggregate over the input,
inlines them as literals and applies one projection or one filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import categorical_cols, collect_row, nan_as_missing, nan_to_null, numeric_cols, ref
from tessera.functions.quantiles import quantiles
from tessera.operators.encode import MISSING

IMPUTATIONS = ("Mean", "Median", "KNN", "Drop Rows")
OUTLIER_METHODS = ("None", "Z-Score", "IQR", "Clip")


def drop_rows(df: DataFrame) -> DataFrame:
    """Remove every row with a missing cell in any column."""
    return nan_to_null(df).dropna(how="any")


def fill_categorical(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    cats = set(categorical_cols(df, exclude=exclude))
    return df.select(*[F.coalesce(ref(c).cast("string"), F.lit(MISSING)).alias(c) if c in cats
                       else ref(c) for c in df.columns])


def impute(df: DataFrame, strategy: str = "Mean", exclude: list[str] = ()) -> DataFrame:
    """Fill numeric gaps per column, categorical gaps with 'Missing'.

    'KNN' in the cleaning step imputes each column on its own: a missing row
    then has no coordinate to measure distance with, so every donor is
    equally far and the fill is the column mean. It is therefore the same
    job as 'Mean'. A numeric column with gaps becomes double (as an integer
    column with gaps is a float column in the source behaviour); an
    all-missing column stays missing; a column without gaps is untouched.
    """
    df = nan_to_null(df)
    if strategy == "Drop Rows":
        return df.dropna(how="any")
    num = numeric_cols(df, exclude=exclude)
    if not num:
        return fill_categorical(df, exclude=list(exclude))
    row = collect_row(df, F.count(F.lit(1)).alias("n"),
                      *[F.struct(F.avg(ref(c).cast("double")).alias("v"), F.count(ref(c)).alias("nn"))
                        .alias(f"c{i}") for i, c in enumerate(num)])
    gaps = [c for i, c in enumerate(num) if row[f"c{i}"]["nn"] < row["n"]]
    medians = quantiles(df, gaps, [0.5]) if strategy == "Median" else {}
    out = []
    for c in df.columns:
        if c in gaps:
            fill = ((medians[c] or [None])[0] if strategy == "Median" else row[f"c{num.index(c)}"]["v"])
            x = ref(c).cast("double")
            out.append((F.coalesce(x, F.lit(fill)) if fill is not None else x).alias(c))
        else:
            out.append(ref(c))
    return fill_categorical(df.select(*out), exclude=list(exclude))


def zscore_filter(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Keep rows whose |z| < 3 on every numeric column (population std).

    A missing z (missing value or NaN, or a constant column) fails the test, so
    a constant numeric column removes every row. The filter itself is on the
    raw columns, so that it is pushed down: NaN is above every bound.
    """
    num = numeric_cols(df, exclude=exclude)
    if not num:
        return df
    s = collect_row(nan_as_missing(df), *[F.struct(F.avg(ref(c).cast("double")).alias("m"),
                                   F.stddev_pop(ref(c).cast("double")).alias("s"),
                                   (F.min(ref(c)) == F.max(ref(c))).alias("const")).alias(f"c{i}")
                          for i, c in enumerate(num)])
    keep = F.lit(True)
    for i, c in enumerate(num):
        st = s[f"c{i}"]
        if st["m"] is None or st["const"]:
            keep = F.lit(False)
            continue
        x = ref(c).cast("double")
        z = (x - F.lit(st["m"])) / F.lit(st["s"])
        # the exact test, plus a slightly wider range on the raw column that
        # parquet can use for row-group pruning (a NULL fails both: in a
        # filter NULL counts as false)
        slack = 3 * st["s"] * (1 + 1e-9) + 1e-12
        keep = keep & (ref(c) >= F.lit(st["m"] - slack)) & (ref(c) <= F.lit(st["m"] + slack)) & (F.abs(z) < 3)
    return df.where(keep)


def iqr_filter(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """One combined mask: every numeric value inside [q25 - 1.5 iqr, q75 + 1.5 iqr]
    (inclusive), all fences from the input. A missing value fails the test."""
    num = numeric_cols(df, exclude=exclude)
    if not num:
        return df
    q = quantiles(nan_as_missing(df), num, [0.25, 0.75])
    keep = F.lit(True)
    for c in num:
        if q[c] is None:
            keep = F.lit(False)
            continue
        q1, q3 = q[c]
        iqr = q3 - q1
        # plain range predicates: NULL fails them inside a filter, and they push down to parquet
        keep = keep & (ref(c) >= F.lit(q1 - 1.5 * iqr)) & (ref(c) <= F.lit(q3 + 1.5 * iqr))
    return df.where(keep)


def clip_percentiles(df: DataFrame, lo: float = 0.01, hi: float = 0.99, exclude: list[str] = ()) -> DataFrame:
    """Clip numeric values to their [1st, 99th] percentiles; missing stays missing,
    integer columns become double."""
    df = nan_as_missing(df)
    num = numeric_cols(df, exclude=exclude)
    if not num:
        return df
    q = quantiles(df, num, [lo, hi])
    out = []
    for c in df.columns:
        if c in num and q[c] is not None:
            a, b = q[c]
            x = ref(c).cast("double")
            # bare greatest/least skip NULL and would invent a value
            out.append(F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(b)), F.lit(a))).alias(c))
        elif c in num:
            out.append(ref(c).cast("double").alias(c))
        else:
            out.append(ref(c))
    return df.select(*out)


def remove_outliers(df: DataFrame, method: str = "None", exclude: list[str] = ()) -> DataFrame:
    if method and method.startswith("Z"):
        return zscore_filter(df, exclude)
    if method and method.startswith("IQR"):
        return iqr_filter(df, exclude)
    if method and method.startswith("Clip"):
        return clip_percentiles(df, exclude=exclude)
    if method not in ("None", "", None):
        raise ValueError(f"unknown outlier method {method!r}; one of {OUTLIER_METHODS}")
    return df
