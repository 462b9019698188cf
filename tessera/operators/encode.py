"""Encode and scale: impute -> scale numeric, fill + one-hot categorical, assemble.

Scalers are DataFrame expressions with statistics collected in one
aggregate (one row per stage), not ML stages: Spark ML's StandardScaler
uses the sample deviation, MinMaxScaler maps constants to 0.5 and
RobustScaler uses approximate quantiles, none of which is the intended
behaviour here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import (categorical_cols, collect_row, nan_to_null,
                                     numeric_cols, ref)
from tessera.functions.quantiles import quantiles

SCALERS = ("StandardScaler", "MinMaxScaler", "RobustScaler")
IMPUTERS = ("Mean", "Median", "KNN")
MISSING = "Missing"


@dataclass(frozen=True)
class FittedScaler:
    kind: str
    center: dict[str, float | None]
    scale: dict[str, float | None]  # None: column scales to 0 (constant / empty)

    def exprs(self, cols: list[str]) -> list[Column]:
        out = []
        for c in cols:
            ctr, sc = self.center.get(c), self.scale.get(c)
            x = ref(c).cast("double")
            if ctr is None:  # all-null column: stays null
                out.append(x.alias(c))
            elif sc is None:
                out.append(F.when(x.isNotNull(), F.lit(0.0)).alias(c))
            else:
                out.append(((x - F.lit(ctr)) / F.lit(sc)).alias(c))
        return out

    def transform(self, df: DataFrame, cols: list[str]) -> DataFrame:
        scaled = dict(zip(cols, self.exprs(cols)))
        return df.select(*[scaled.get(c, ref(c)) for c in df.columns])


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "StandardScaler") -> FittedScaler:
    """Statistics for one scaler over ``cols`` in a single aggregate job."""
    if kind not in SCALERS:
        kind = "StandardScaler"  # unknown names fall back, as in the source behaviour
    if not cols:
        return FittedScaler(kind, {}, {})
    aggs = []
    for i, c in enumerate(cols):
        x = ref(c).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
        if kind == "StandardScaler":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = collect_row(df, *aggs)
    qs = quantiles(df, cols, [0.25, 0.5, 0.75]) if kind == "RobustScaler" else {}
    center, scale = {}, {}
    for i, c in enumerate(cols):
        mn, mx = row[f"mn{i}"], row[f"mx{i}"]
        if mn is None:
            center[c], scale[c] = None, None
            continue
        if kind == "StandardScaler":
            center[c] = row[f"a{i}"]
            scale[c] = None if mn == mx else row[f"s{i}"]
        elif kind == "MinMaxScaler":
            center[c] = mn
            scale[c] = None if mn == mx else mx - mn
        else:
            q25, q50, q75 = qs[c]
            center[c] = q50
            iqr = q75 - q25
            scale[c] = 1.0 if iqr == 0 else iqr
            if mn == mx:  # (x - median) / 1 is exactly 0 for a constant column
                scale[c] = 1.0
    return FittedScaler(kind, center, scale)


def scale(df: DataFrame, cols: list[str], kind: str = "StandardScaler") -> DataFrame:
    return fit_scaler(df, cols, kind).transform(df, cols)


# ---------------------------------------------------------------- imputation

@dataclass(frozen=True)
class FittedImputer:
    strategy: str
    fill: dict[str, float | None]

    def transform(self, df: DataFrame, cols: list[str]) -> DataFrame:
        out = []
        for c in df.columns:
            if c in cols and self.fill.get(c) is not None:
                out.append(F.coalesce(ref(c).cast("double"), F.lit(self.fill[c])).alias(c))
            elif c in cols:
                out.append(ref(c).cast("double").alias(c))
            else:
                out.append(ref(c))
        return df.select(*out)


def fit_imputer(df: DataFrame, cols: list[str], strategy: str = "Mean") -> FittedImputer:
    """Mean or exact (linear) median per column, one aggregate job.

    An all-null column has no statistic and stays null.
    """
    if not cols:
        return FittedImputer(strategy, {})
    if strategy == "Median":
        med = quantiles(df, cols, [0.5])
        return FittedImputer(strategy, {c: (med[c] or [None])[0] for c in cols})
    row = collect_row(df, *[F.avg(ref(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    return FittedImputer(strategy, {c: row[f"v{i}"] for i, c in enumerate(cols)})


# ------------------------------------------------------------------ one-hot

def fit_categories(df: DataFrame, cols: list[str], max_categories: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct values (NULL -> 'Missing') per categorical column.

    Guarded: an approximate distinct count runs first so that a high-
    cardinality column fails with its name instead of collecting an
    unbounded list to the driver.
    """
    if not cols:
        return {}
    approx = collect_row(df, *[F.approx_count_distinct(ref(c)).alias(f"d{i}")
                               for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        if approx[f"d{i}"] > max_categories:
            raise ValueError(
                f"column {c!r} has about {approx[f'd{i}']} categories, above "
                f"max_categories={max_categories}; drop it or raise the limit")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.coalesce(ref(c).cast("string"), F.lit(MISSING)).alias("v"))
        for i, c in enumerate(cols)])).alias("p")).select("p.i", "p.v").distinct()
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in pairs.collect():  # bounded by len(cols) * max_categories
        cats[cols[r["i"]]].append(r["v"])
    return {c: sorted(v) for c, v in cats.items()}


def one_hot_exprs(cats: dict[str, list[str]]) -> tuple[list[Column], list[str]]:
    exprs, names = [], []
    for c, values in cats.items():
        filled = F.coalesce(ref(c).cast("string"), F.lit(MISSING))
        for v in values:
            exprs.append(F.when(filled == F.lit(v), 1.0).otherwise(0.0))
            names.append(f"{c}_{v}")
    return exprs, names


def one_hot(df: DataFrame, cols: list[str], max_categories: int = 1000) -> DataFrame:
    cats = fit_categories(df, cols, max_categories)
    exprs, names = one_hot_exprs(cats)
    keep = [ref(c) for c in df.columns if c not in cols]
    return df.select(*keep, *[e.alias(n) for e, n in zip(exprs, names)])


def one_hot_sparse(df: DataFrame, key_cols: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """((keys, indices), dictionary): the positions of the ones, for any number
    of categories. The dictionary (column, value, index), ordered by column
    and value, is a table that is joined, never collected."""
    from tessera.operators.graph import dense_index
    long = df.select(*[ref(c) for c in key_cols], F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.coalesce(ref(c).cast("string"), F.lit(MISSING)).alias("v"))
        for i, c in enumerate(cols)])).alias("_cv"))
    index = dense_index(long, "_cv", out="index").withColumn("index", F.col("index").cast("long"))
    ones = (long.join(index, "_cv").groupBy(*[ref(c) for c in key_cols])
            .agg(F.array_sort(F.collect_list("index")).alias("indices")))
    names = F.array(*[F.lit(c) for c in cols])
    return ones, index.select(names[F.col("_cv.i")].alias("column"), F.col("_cv.v").alias("value"), "index")


# ----------------------------------------------------------------- assemble

@dataclass(frozen=True)
class Encoded:
    """Result of :func:`preprocess`: ``frame`` has the key columns and ``x``."""
    frame: DataFrame
    feature_names: list[str]
    numeric: list[str]
    scaler: FittedScaler
    imputer: FittedImputer | None
    categories: dict[str, list[str]] = field(default_factory=dict)
    source: DataFrame | None = None  # the persisted input (keys + raw features), before imputation

    @property
    def dim(self) -> int:
        return len(self.feature_names)


def vector_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in set(exclude)
            and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]


def _check_finite(df: DataFrame, num: list[str], vectors: list[str]) -> dict[str, int]:
    """Refuse infinities and arrays with gaps or of different lengths; the arrays' lengths. One aggregate."""
    infinite = [F.count(F.when(F.abs(ref(c).cast("double")) == float("inf"), 1)).alias(f"i{i}") for i, c in enumerate(num)]
    odd = [F.struct(
        F.min(F.size(ref(c))).alias("least"), F.max(F.size(ref(c))).alias("most"), F.count(F.when(ref(c).isNull(), 1)).alias("nulls"),
        F.count(F.when(F.exists(ref(c), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))), 1)).alias("gaps"))
        .alias(f"v{i}") for i, c in enumerate(vectors)]
    if not infinite and not odd:
        return {}
    row = collect_row(df, *infinite, *odd)
    bad = [c for i, c in enumerate(num) if row[f"i{i}"]]
    if bad:
        raise ValueError(f"infinite values in {bad}")
    for i, c in enumerate(vectors):
        s = row[f"v{i}"]
        if s["nulls"] or s["gaps"] or s["least"] != s["most"]:
            raise ValueError(f"the arrays of {c!r} must all be there, of one length and finite")
    return {c: row[f"v{i}"]["most"] or 0 for i, c in enumerate(vectors)}


def preprocess(df: DataFrame, key_cols: list[str], scaler: str = "StandardScaler",
               imputer: str = "Mean", max_categories: int = 1000, knn_k: int = 5) -> Encoded:
    """Numeric block (imputed, scaled) then one-hot block, as ``x: array<double>``.

    Columns that are entirely missing are dropped from ``x`` (they have no
    statistic to impute with). With no usable column, ``x`` is one zero.
    Arrays of numbers are ready-made features: their elements follow the others
    as they are, and every row needs one of the same length without gaps.
    Columns of other types and infinite values are refused before any fitting.
    """
    df = nan_to_null(df)
    num = numeric_cols(df, exclude=key_cols)
    cat = categorical_cols(df, exclude=key_cols)
    vectors = vector_cols(df, exclude=key_cols)
    other = [c for c in df.columns if c not in {*key_cols, *num, *cat, *vectors}]
    if other:
        raise ValueError(f"columns {other} are neither numbers, texts nor arrays of numbers; leave them out or flatten them")
    widths = _check_finite(df, num, vectors)
    if num:
        present = collect_row(df, *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(num)])
        num = [c for i, c in enumerate(num) if present[f"n{i}"] > 0]
    # every statistic pass below and the encoded frame read this table
    keys = [ref(k) for k in key_cols]
    base = (df.select(*keys, *[ref(c).cast("double").alias(c) for c in num], *[ref(c) for c in cat],
                      *[ref(c).cast("array<double>").alias(c) for c in vectors]).persist(StorageLevel.MEMORY_AND_DISK))
    source = base
    fitted_imp = None
    if num:
        if imputer == "KNN":
            from tessera.operators.knn import knn_impute
            base = knn_impute(base, key_cols, num, k=knn_k)
        else:
            fitted_imp = fit_imputer(base, num, "Median" if imputer == "Median" else "Mean")
            base = fitted_imp.transform(base, num)
    fitted_sc = fit_scaler(base, num, scaler)
    cats = fit_categories(base, cat, max_categories)
    oh_exprs, oh_names = one_hot_exprs(cats)
    parts = fitted_sc.exprs(num) + oh_exprs
    names = list(num) + oh_names
    names += [f"{c}_{i}" for c in vectors for i in range(widths[c])]
    if not names:
        parts, names = [F.lit(0.0)], ["zero"]
    x = F.array(*[p.cast("double") for p in parts]) if parts else F.array().cast("array<double>")
    frame = base.select(*keys, F.concat(x, *[ref(c) for c in vectors]).alias("x") if vectors else x.alias("x"))
    return Encoded(frame, names, num, fitted_sc, fitted_imp, cats, source)


def assemble(df: DataFrame, key_cols: list[str], cols: list[str]) -> DataFrame:
    """Plain assembly of already-numeric columns into ``x`` (no scaling)."""
    return df.select(*[ref(k) for k in key_cols], F.array(*[ref(c).cast("double") for c in cols]).alias("x"))
