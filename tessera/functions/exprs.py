"""Type classes, null handling and small expression builders.

Numeric means a Spark ``NumericType`` column; everything else that is a
scalar is categorical. ``NaN`` is turned into NULL on entry so that no
aggregate downstream has to care about it (Spark's ``avg`` is poisoned by
NaN, and ``count(distinct)`` counts it).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CATEGORICAL_CASTS = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in skip
            and (isinstance(f.dataType, T.StringType)
                 or isinstance(f.dataType, _CATEGORICAL_CASTS))]


def null_if_nan(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def ref(name: str) -> Column:
    """The column of that name, whatever characters it has (dots included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_as_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float/double column; types stay."""
    return df.select(*[null_if_nan(ref(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ref(f.name)
                       for f in df.schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float/double column; booleans/dates -> strings."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(null_if_nan(ref(f.name)).alias(f.name))
        elif isinstance(f.dataType, _CATEGORICAL_CASTS):
            out.append(ref(f.name).cast("string").alias(f.name))
        else:
            out.append(ref(f.name))
    return df.select(*out)


def collect_row(df: DataFrame, *aggs: Column) -> Row:
    """Run one aggregate over the whole frame and bring back its single row.

    All statistics of one stage go into one job; the result is bounded by
    the number of expressions, not by the number of rows.
    """
    return df.agg(*aggs).collect()[0]


def round_binary(c: Column, digits: int = 6) -> Column:
    """Round as ``round(x * 10^d) / 10^d`` in binary floating point.

    Spark's ``round`` rounds the decimal rendering of the double, so a value
    printed as an exact tie (0.0499185) rounds up, while rounding the
    scaled binary value (0.04991849999...) rounds down. The binary rule is
    the common one across engines, which keeps outputs bit-identical.
    """
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column at output (never inside a stage), in two
    steps: to ``digits + 3`` first, which absorbs last-bit noise from
    summation order, then to ``digits``."""
    return df.select(*[
        round_binary(round_binary(ref(f.name), digits + 3), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else ref(f.name)
        for f in df.schema.fields])


def sq_dist(a: str, b: str, dim: int) -> Column:
    """Squared Euclidean distance between two array<double> columns.

    Spelled out element by element so that it stays one codegen'd
    expression (``aggregate(zip_with(...))`` is an interpreted lambda).
    """
    terms = [(F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(dim)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total
