"""Table profile: shape, column overview, describe, missing share, histogram,
box statistics, correlation, outlier counts, top categories, and the
column-removal suggestions derived from them.

Every operator runs all of its columns in one aggregate and returns a small
DataFrame in long form (one row per column or per column pair). Exact
quantiles use the linear rule (``tessera.functions.quantiles``: Spark's
``percentile`` for columns with few distinct values, distributed order
statistics otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, nan_as_missing, numeric_cols, ref
from tessera.functions.quantiles import quantiles
from tessera.operators.gramian import column_moments


#: Relative error of the distinct sketches, and how far (in those) an estimate may be off before a column is ruled out.
SKETCH_ERROR = 0.01
SKETCH_MARGIN = 8


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct count (missing ignored) of every column: two 64-bit
    hashes of the values are unpivoted to (column, hashes), made distinct with
    a map-side combine and counted per column."""
    kinds = dict(df.dtypes)
    def plain(c):
        return ((ref(c) + 0.0) if kinds[c] in ("double", "float") else ref(c)).cast("string")
    values = [F.struct(F.lit(i).alias("i"), F.when(ref(c).isNotNull(), F.xxhash64(plain(c))).alias("a"), F.xxhash64(F.lit(1), plain(c)).alias("b"))
              for i, c in enumerate(cols)]
    pairs = df.select(F.explode(F.array(*values)).alias("p")).select("p.*").where("a is not null").distinct()
    found = {r["i"]: r["n"] for r in pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(cols)}


def distinct_sketches(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, tuple[int, float]]]:
    """(rows, {column: (values present, estimated distinct values)}): one scan
    with a mergeable sketch a column, nothing shuffled but the sketches."""
    row = collect_row(df, F.count(F.lit(1)).alias("n"), *[F.struct(
        F.count(ref(c)).alias("n"), F.approx_count_distinct(ref(c), SKETCH_ERROR).alias("d"),
        F.min(ref(c)).alias("lo"), F.max(ref(c)).alias("hi")).alias(f"c{i}") for i, c in enumerate(cols)])
    out = {}
    for i, c in enumerate(cols):
        s = row[f"c{i}"]
        one = s["n"] > 0 and s["lo"] == s["hi"]  # exactly known without counting
        out[c] = (s["n"], float(1 if one else max(2, s["d"])) if s["n"] else 0.0)
    return row["n"], out


# ----------------------------------------------------------------- E1 shape

def shape(df: DataFrame) -> DataFrame:
    """rows, columns, numeric columns, total missing cells."""
    num = set(numeric_cols(df))
    missing = [F.sum(F.when(ref(c).isNull() | (F.isnan(ref(c)) if c in num else F.lit(False)), 1)
                     .otherwise(0)) for c in df.columns]
    total = missing[0]
    for m in missing[1:]:
        total = total + m
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("columns"),
                  F.lit(len(num)).cast("bigint").alias("numeric_columns"),
                  total.cast("bigint").alias("total_missing"))


# ------------------------------------------------------- E2 column overview

def column_overview(df: DataFrame, order_by: str) -> DataFrame:
    """type, missing, unique (missing ignored), first non-missing value by key."""
    df = nan_as_missing(df)
    cols, dtypes = list(df.columns), dict(df.dtypes)
    unique = distinct_counts(df, cols)
    agg = df.agg(*[F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count(ref(c)).alias("nn"),
        F.min_by(ref(c).cast("string"), F.when(ref(c).isNotNull(), F.col(order_by))).alias("s"),
    ).alias(f"c{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                        (F.col(f"c{i}.n") - F.col(f"c{i}.nn")).alias("missing"),
                        F.lit(unique[c]).cast("bigint").alias("unique"),
                        F.coalesce(F.col(f"c{i}.s"), F.lit("—")).alias("sample"))
               for i, c in enumerate(cols)]
    return agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ---------------------------------------------------------------- E3 describe

def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max per numeric column."""
    df = nan_as_missing(df)
    cols = cols or numeric_cols(df)
    qs = quantiles(df, cols, [0.25, 0.5, 0.75])
    agg = df.agg(*[F.struct(
        F.count(ref(c)).alias("count"),
        F.avg(ref(c).cast("double")).alias("mean"),
        F.stddev_samp(ref(c).cast("double")).alias("std"),
        F.min(ref(c).cast("double")).alias("min"),
        F.array(*[F.lit(v).cast("double") for v in (qs[c] or [None, None, None])]).alias("q"),
        F.max(ref(c).cast("double")).alias("max")).alias(f"c{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}.count").alias("count"),
                        F.col(f"c{i}.mean").alias("mean"), F.col(f"c{i}.std").alias("std"),
                        F.col(f"c{i}.min").alias("min"), F.col(f"c{i}.q")[0].alias("q25"),
                        F.col(f"c{i}.q")[1].alias("q50"), F.col(f"c{i}.q")[2].alias("q75"),
                        F.col(f"c{i}.max").alias("max")) for i, c in enumerate(cols)]
    return agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ---------------------------------------------------------- E4 missing share

def missing_pct(df: DataFrame) -> DataFrame:
    """Percentage of missing cells per column, only columns with any."""
    num = set(numeric_cols(df))
    agg = df.agg(*[F.avg(F.when(ref(c).isNull() | (F.isnan(ref(c)) if c in num else F.lit(False)), 1.0)
                         .otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    structs = [F.struct(F.lit(c).alias("column"), (F.col(f"c{i}") * 100.0).alias("missing_pct"))
               for i, c in enumerate(df.columns)]
    return (agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
            .where(F.col("missing_pct") > 0))


# ---------------------------------------------------------------- E5 histogram

def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins on [min, max]; empty bins kept; constant column -> 1 bin."""
    df = nan_as_missing(df)
    stats = collect_row(df, F.min(ref(col).cast("double")).alias("mn"),
                        F.max(ref(col).cast("double")).alias("mx"))
    mn, mx = stats["mn"], stats["mx"]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint")
    nb = 1 if mn == mx else bins
    width = (mx - mn) / nb if mx > mn else 0.0
    x = ref(col).cast("double")
    b = (F.lit(0) if nb == 1 else F.least(F.lit(nb - 1), F.floor((x - F.lit(mn)) / F.lit(width)).cast("int")))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
                    F.when(F.col("bin") == nb - 1, F.lit(mx))
                    .otherwise(F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


# ------------------------------------------------------------- E6 box stats

def box_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers (extreme values inside the fences)
    and outlier counts. Two passes: quartiles, then fences as literals."""
    df = nan_as_missing(df)
    cols = cols or numeric_cols(df)
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs, meta = [], []
    for c in cols:
        qs = q[c]
        if qs is None:
            continue
        q1, q2, q3 = qs
        iqr = q3 - q1
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        x = ref(c).cast("double")
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"),
            F.lit(q3).alias("q3"), F.lit(iqr).alias("iqr"), F.lit(lo).alias("lower_fence"),
            F.lit(hi).alias("upper_fence"),
            F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
            F.count(F.when(x.isNotNull() & ~inside, 1)).alias("n_outliers")).alias(f"b{len(meta)}"))
        meta.append(c)
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string")
    agg = df.agg(*aggs)
    return agg.select(F.explode(F.array(*[F.col(f"b{i}") for i in range(len(meta))])).alias("r")).select("r.*")


# ------------------------------------------------------------ C1 correlation

#: Pairs of columns up to which one aggregate computes all coefficients; wider tables use Gramian blocks.
PAIRS_IN_ONE = 150


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson r for every ordered column pair on pairwise-complete rows, in
    one scan of the table however many columns there are.

    A column that is constant on the rows of a pair yields NULL.
    """
    df = nan_as_missing(df)
    cols = cols or numeric_cols(df)
    if len(cols) * (len(cols) + 1) // 2 > PAIRS_IN_ONE:
        return corr_gramian(df, cols)
    exprs, structs = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xa, xb = ref(a).cast("double"), ref(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            ya, yb = F.when(both, xa), F.when(both, xb)
            k = len(exprs)
            varies = (F.min(ya) < F.max(ya)) & (F.min(yb) < F.max(yb))  # merged deviations of a constant are not always 0
            exprs.append(F.when(varies, F.try_divide(F.covar_pop(ya, yb), F.stddev_pop(ya) * F.stddev_pop(yb))).alias(f"r{k}"))
            structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{k}").alias("r")))
            if a != b:
                structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"r{k}").alias("r")))
    return df.agg(*exprs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def corr_gramian(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The same from masked Gramian blocks, for any number of columns."""
    cols = cols or numeric_cols(df)
    r = column_moments(df, [ref(c) for c in cols]).correlation()
    rows = [(a, b, None if r[i, j] != r[i, j] else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")


def high_corr_pairs(df: DataFrame, threshold: float = 0.8, cols: list[str] | None = None) -> DataFrame:
    """Upper-triangle pairs (column order) with |r| > threshold, r rounded to 3."""
    cols = cols or numeric_cols(df)
    pos = {c: i for i, c in enumerate(cols)}
    cm = corr_matrix(df, cols)
    order = df.sparkSession.createDataFrame(list(pos.items()), "col string, pos int")  # a row a column
    first, second = order.toDF("col_a", "_pa"), order.toDF("col_b", "_pb")
    return (cm.where(F.abs("r") > threshold).join(F.broadcast(first), "col_a").join(F.broadcast(second), "col_b").where("_pa < _pb")
            .select("col_a", "col_b", F.bround("r", 3).alias("r")))


# ------------------------------------------------------------- E8/E9 outliers

def outlier_counts(df: DataFrame, col: str) -> DataFrame:
    """|z| > 3 (population std) and outside the 1.5 IQR fences, on non-missing values."""
    df = nan_as_missing(df)
    x = ref(col).cast("double")
    s = collect_row(df, F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    if s["m"] is None:
        return df.sparkSession.createDataFrame([(col, 0, 0, 0)],
                                               "column string, z_outliers bigint, iqr_outliers bigint, n bigint")
    q1, q3 = quantiles(df, [col], [0.25, 0.75])[col]
    iqr = q3 - q1
    z = F.try_divide(x - F.lit(s["m"]), F.lit(s["s"]))
    return df.where(x.isNotNull()).agg(
        F.lit(col).alias("column"),
        F.count(F.when(F.abs(z) > 3, 1)).alias("z_outliers"),
        F.count(F.when((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr)), 1)).alias("iqr_outliers"),
        F.count(F.lit(1)).alias("n"))


def outlier_points(df: DataFrame, col: str, key_cols: list[str]) -> DataFrame:
    """Every non-missing value with its z-score and the |z| > 3 flag."""
    df = nan_as_missing(df)
    x = ref(col).cast("double")
    s = collect_row(df, F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    z = F.try_divide(x - F.lit(s["m"]), F.lit(s["s"]))
    return (df.where(x.isNotNull())
            .select(*[ref(k) for k in key_cols], x.alias("value"), z.alias("z"),
                    F.coalesce(F.abs(z) > 3, F.lit(False)).alias("is_outlier")))


# ------------------------------------------------------------- E10 top values

def top_categories(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Most frequent non-missing values; ties broken by value."""
    df = nan_as_missing(df)
    return (df.where(ref(col).isNotNull())
            .groupBy(ref(col).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("value")).limit(n))


# ------------------------------------------------ P3/P4/P8 suggestions, checks

def auto_remove(df: DataFrame) -> DataFrame:
    """Columns whose exact distinct count (missing ignored) equals the row count or is <= 1.

    Smallest and largest value decide the constant ones. All-distinct columns
    must be complete and have an estimated distinct count near the row count;
    only those few candidates are counted exactly.
    """
    df = nan_as_missing(df)
    n, sketch = distinct_sketches(df, df.columns)
    far = 1 - SKETCH_MARGIN * SKETCH_ERROR
    near = [c for c, (present, d) in sketch.items() if d > 1 and present == n and d >= far * n]
    unique = {c: int(d) for c, (_, d) in sketch.items() if d <= 1}
    unique |= distinct_counts(df.select(*[ref(c) for c in near]), near) if near else {}
    rows = [(c, unique[c], n) for c in df.columns if c in unique and (unique[c] == n or unique[c] <= 1)]
    return df.sparkSession.createDataFrame(rows, "column string, unique bigint, rows bigint")


def low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Numeric columns whose population variance (missing as 0) is < threshold.

    When no column exceeds the threshold the suggestion list is empty (the
    selector refuses to fit in that case).
    """
    df = nan_as_missing(df)
    cols = numeric_cols(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, variance double")
    agg = df.agg(*[F.var_pop(F.coalesce(ref(c).cast("double"), F.lit(0.0))).alias(f"v{i}")
                   for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(cols)]
    long = agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    # the long table has one row per column, so an unpartitioned window is bounded
    any_high = F.max(F.col("variance") > threshold).over(Window.partitionBy())
    return long.withColumn("_any", any_high).where(F.col("_any") & (F.col("variance") < threshold)).drop("_any")


def select_features(df: DataFrame, exclude: list[str] = (), threshold: float = 0.01) -> list[str]:
    """Names of the columns kept by default: all but the low-variance numeric
    ones; ``exclude`` (keys) is neither judged nor removed."""
    low = {r["column"] for r in low_variance(df.select(*[ref(c) for c in df.columns if c not in exclude]), threshold).collect()}
    return [c for c in df.columns if c not in low]


def dropna_impact(df: DataFrame) -> DataFrame:
    """Rows before/after dropping any-missing rows, and the loss warning."""
    num = set(numeric_cols(df))
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & ref(c).isNotNull() & (~F.isnan(ref(c)) if c in num else F.lit(True))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(complete, 1)).alias("rows_after"))
    pct = F.try_divide(F.col("rows_after") * 100.0, F.col("rows"))
    return agg.select("rows", "rows_after", pct.alias("pct_kept"),
                      ((F.col("rows_after") < 50) | (F.round(pct, 1) < 30)).alias("warn"))



# ------------------------------------------------------------ E7 x/y pairs

def xy_pairs(df: DataFrame, key_cols: list[str], x: str, y: str, color: str | None = None) -> DataFrame:
    """The points of an x/y scatter (all rows; sample downstream with the
    deterministic sample when a display needs fewer)."""
    df = nan_as_missing(df)
    cols = [*[ref(k) for k in key_cols], ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y")]
    if color:
        cols.append(ref(color).cast("string").alias("color"))
    return df.select(*cols)
