"""Registered queries: each is a Spark job over the given tables (whole
tables, no row subsets) and, where SQL can express it, an independent
DuckDB oracle written from the semantics, not from the DataFrame code.

Doubles are rounded to 6 decimals at output on both sides; counts are
BIGINT on both sides; every computed column is aliased identically.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import round_doubles
from tessera.operators import clean, encode, features, kmeans, profile, quality, results
from tessera.operators.dbscan import dbscan, dbscan_fit
from tessera.sources import tables as T


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _two_step_round(sql: str) -> str:
    """Rewrite every ``round(e, 6)`` as ``round(round(e, 9), 6)``.

    The Spark side rounds the same way (see ``round_doubles``): the first
    step absorbs last-bit differences of sums taken in another order, so a
    value that is an exact decimal tie at the 7th digit rounds the same in
    both engines.
    """
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6:k - 1]
        head, sep, digits = inner.rpartition(",")
        if sep and digits.strip() == "6":
            out.append(sql[i:j] + "round(round(" + _two_step_round(head) + ", 9), 6)")
        else:
            out.append(sql[i:j] + "round(" + _two_step_round(inner) + ")")
        i = k


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, _two_step_round(sql) if sql else None)
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    return round_doubles(df, 6)


# ----------------------------------------------------------- SQL fragments
# Derived inputs, written once for the oracle side.

SQL_CF = """customer_features AS (
  SELECT c.c_custkey, c.c_acctbal AS acctbal, CAST(o.n AS DOUBLE) AS n_orders, o.avg_total
  FROM customer c JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS avg_total
                        FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""

SQL_UF = """user_features AS (
  SELECT user_id, CAST(count(*) AS DOUBLE) AS n, avg(value) AS avg_value,
         avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate
  FROM events GROUP BY user_id)"""

SQL_EG = """events_gaps AS (
  SELECT event_id, user_id,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 AND event_id % 19 <> 0 THEN value END AS value
  FROM events)"""

SQL_PG = """part_gaps AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size,
         CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN p_retailprice END AS p_retailprice,
         p_type
  FROM part)"""

SQL_PS = SQL_PG + """,
part_spikes AS (
  SELECT p_partkey, p_size, CASE WHEN p_partkey % 97 = 0 THEN p_retailprice * 1000 ELSE p_retailprice END AS p_retailprice, p_type
  FROM part_gaps)"""

SQL_PW = """part_wide AS (
  SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS DOUBLE) * p_retailprice AS size_x_price,
         CAST(5.0 AS DOUBLE) AS const5, p_type
  FROM part)"""

SQL_LN = """line_num AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""

SQL_LS = """line_spikes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN (l_partkey + l_suppkey) % 89 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS l_quantity,
         CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN l_extendedprice * 1000 ELSE l_extendedprice END AS l_extendedprice,
         l_discount, l_tax
  FROM lineitem)"""

SQL_EL = """embed_labelled AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS cluster FROM embeddings)"""


def sql_zscore(src: str, key: str, cols: list[str], name: str = "z") -> str:
    """Population z-scores; a constant column scores 0."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) = max({c}) AS k_{c}" for c in cols)
    zs = ", ".join(f"CASE WHEN k_{c} THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS {c}" for c in cols)
    return (f"{name}_st AS (SELECT {stats} FROM {src}),\n"
            f"{name} AS (SELECT {key}, {zs} FROM {src}, {name}_st)")


def sql_dbscan(zsrc: str, key: str, cols: list[str], eps: float, min_samples: int, name: str = "lab") -> str:
    """DBSCAN labels in SQL: neighbour pairs, core, transitive closure over
    core-core pairs, border = smallest neighbouring core cluster."""
    d2 = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in cols)
    return f"""{name}_nb AS MATERIALIZED (SELECT p.{key} AS i, q.{key} AS j FROM {zsrc} p JOIN {zsrc} q
       ON {d2} <= {eps} * {eps}),
{name}_core AS MATERIALIZED (SELECT i FROM {name}_nb GROUP BY i HAVING count(*) >= {min_samples}),
{name}_cc AS MATERIALIZED (SELECT n.i, n.j FROM {name}_nb n JOIN {name}_core a ON n.i = a.i
       JOIN {name}_core b ON n.j = b.i),
{name}_reach(i, j) AS (SELECT i, i FROM {name}_core
       UNION SELECT r.i, c.j FROM {name}_reach r JOIN {name}_cc c ON r.j = c.i),
{name}_root AS (SELECT i, min(j) AS r FROM {name}_reach GROUP BY i),
{name}_num AS (SELECT i, CAST(dense_rank() OVER (ORDER BY r) - 1 AS INTEGER) AS cl FROM {name}_root),
{name}_border AS (SELECT n.i, min(u.cl) AS cl FROM {name}_nb n JOIN {name}_num u ON n.j = u.i
       WHERE n.i NOT IN (SELECT i FROM {name}_core) GROUP BY n.i),
{name} AS (SELECT z.{key}, CAST(coalesce(u.cl, b.cl, -1) AS INTEGER) AS cluster FROM {zsrc} z
       LEFT JOIN {name}_num u ON z.{key} = u.i LEFT JOIN {name}_border b ON z.{key} = b.i)"""


CF_COLS = ["acctbal", "n_orders", "avg_total"]
UF_COLS = ["n", "avg_value", "error_rate"]
EPS_CF_001 = 0.4  # customer_features at sf0.01 (1,500 rows)
EPS_UF = 0.6      # user_features (150 users at sf0.01)


def _cf_labels(spark: SparkSession, sf: str, eps: float = EPS_CF_001) -> DataFrame:
    cf = T.customer_features(spark, sf)
    enc = encode.preprocess(cf, ["c_custkey"], "StandardScaler", "Mean")
    return dbscan(enc.frame, "c_custkey", eps, 5)


def _uf_labelled(spark: SparkSession, sf: str) -> DataFrame:
    uf = T.user_features(spark, sf)
    enc = encode.preprocess(uf, ["user_id"], "StandardScaler", "Mean")
    lab = dbscan(enc.frame, "user_id", EPS_UF, 5)
    return results.label_join(enc.source.select(*uf.columns), lab, ["user_id"])


SQL_UF_LAB = ",\n".join([SQL_UF, sql_zscore("user_features", "user_id", UF_COLS, "uz"),
                         sql_dbscan("uz", "user_id", UF_COLS, EPS_UF, 5, "ulab"),
                         "labelled AS (SELECT f.*, l.cluster FROM user_features f JOIN ulab l USING (user_id))"])

# ================================================================ sources

@register("preview", """
SELECT * FROM customer ORDER BY c_custkey LIMIT 20""")
def q_preview(spark, sf):
    return T.table(spark, sf, "customer").orderBy("c_custkey").limit(20)


# ================================================================ profile

@register("shape", f"""
WITH {SQL_EG}
SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numeric_columns,
       CAST(count(*) - count(event_id) + count(*) - count(user_id) + count(*) - count(event_type)
            + count(*) - count(value) AS BIGINT) AS total_missing
FROM events_gaps""")
def q_shape(spark, sf):
    return profile.shape(T.events_gaps(spark, sf))


@register("column_overview", f"""
WITH {SQL_EG},
firsts AS (
  SELECT arg_min(CAST(event_id AS VARCHAR), event_id) AS s_event_id,
         arg_min(CAST(user_id AS VARCHAR), event_id) AS s_user_id,
         arg_min(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS s_event_type,
         arg_min(CAST(value AS VARCHAR), event_id) FILTER (WHERE value IS NOT NULL) AS s_value
  FROM events_gaps)
SELECT 'event_id' AS "column", 'bigint' AS dtype, CAST(count(*) - count(event_id) AS BIGINT) AS missing,
       CAST(count(DISTINCT event_id) AS BIGINT) AS "unique", any_value(s_event_id) AS sample FROM events_gaps, firsts
UNION ALL
SELECT 'user_id', 'bigint', CAST(count(*) - count(user_id) AS BIGINT), CAST(count(DISTINCT user_id) AS BIGINT),
       any_value(s_user_id) FROM events_gaps, firsts
UNION ALL
SELECT 'event_type', 'string', CAST(count(*) - count(event_type) AS BIGINT),
       CAST(count(DISTINCT event_type) AS BIGINT), any_value(s_event_type) FROM events_gaps, firsts
UNION ALL
SELECT 'value', 'double', CAST(count(*) - count(value) AS BIGINT), CAST(count(DISTINCT value) AS BIGINT),
       any_value(s_value) FROM events_gaps, firsts""")
def q_column_overview(spark, sf):
    return profile.column_overview(T.events_gaps(spark, sf), "event_id")


def _describe_sql(src: str, cols: list[str], cte: str) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
            f"round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {src}")
    return f"WITH {cte}\n" + "\nUNION ALL\n".join(parts)


LN_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


@register("describe", _describe_sql("line_num", LN_COLS, SQL_LN))
def q_describe(spark, sf):
    return r6(profile.describe(T.line_num(spark, sf)))


@register("describe_gaps", _describe_sql("part_gaps", ["p_partkey", "p_size", "p_retailprice"], SQL_PG))
def q_describe_gaps(spark, sf):
    return r6(profile.describe(T.part_gaps(spark, sf)))


@register("missing_pct", f"""
WITH {SQL_EG},
m AS (
  SELECT 'event_id' AS "column", avg(CASE WHEN event_id IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS p FROM events_gaps
  UNION ALL SELECT 'user_id', avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM events_gaps
  UNION ALL SELECT 'event_type', avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM events_gaps
  UNION ALL SELECT 'value', avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM events_gaps)
SELECT "column", round(p, 6) AS missing_pct FROM m WHERE p > 0""")
def q_missing_pct(spark, sf):
    return r6(profile.missing_pct(T.events_gaps(spark, sf)))


@register("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx,
                  (max(l_extendedprice) - min(l_extendedprice)) / 40 AS w FROM lineitem),
b AS (SELECT least(39, CAST(floor((l_extendedprice - mn) / w) AS INTEGER)) AS bin FROM lineitem, s),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(40))
SELECT g.bin, round(mn + g.bin * w, 6) AS lo,
       round(CASE WHEN g.bin = 39 THEN mx ELSE mn + (g.bin + 1) * w END, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")
def q_histogram(spark, sf):
    return r6(profile.histogram(T.table(spark, sf, "lineitem"), "l_extendedprice", 40))


def _box_sql(src: str, cols: list[str], cte: str) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
  round(min(CASE WHEN {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {c} END), 6) AS whisker_lo,
  round(max(CASE WHEN {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {c} END), 6) AS whisker_hi,
  CAST(count(CASE WHEN {c} IS NOT NULL AND NOT ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
                  THEN 1 END) AS BIGINT) AS n_outliers
FROM {src}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
                    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src}) q
GROUP BY q1, q2, q3""")
    return f"WITH {cte}\n" + "\nUNION ALL\n".join(parts)


@register("box_stats", _box_sql("part_spikes", ["p_partkey", "p_size", "p_retailprice"], SQL_PS))
def q_box_stats(spark, sf):
    return r6(profile.box_stats(T.part_spikes(spark, sf)))


PW_NUM = ["p_partkey", "p_size", "p_retailprice", "size_x_price", "const5"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(PW_NUM):
        for b in PW_NUM:
            r = (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
                 f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({r}, 6) AS r FROM part_wide")
    return f"WITH {SQL_PW}\n" + "\nUNION ALL\n".join(parts)


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return r6(profile.corr_matrix(T.part_wide(spark, sf), PW_NUM))


def _high_corr_sql() -> str:
    parts = []
    for i, a in enumerate(PW_NUM):
        for b in PW_NUM[i + 1:]:
            r = (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
                 f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r} AS r FROM part_wide")
    return (f"WITH {SQL_PW}, c AS (" + "\nUNION ALL\n".join(parts) + ")\n"
            "SELECT col_a, col_b, round(r, 3) AS r FROM c WHERE abs(r) > 0.8")


@register("high_corr_pairs", _high_corr_sql())
def q_high_corr_pairs(spark, sf):
    return profile.high_corr_pairs(T.part_wide(spark, sf), 0.8, PW_NUM)


@register("outlier_counts", f"""
WITH {SQL_LS}, s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd,
                  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM line_spikes)
SELECT 'l_extendedprice' AS "column",
       CAST(count(CASE WHEN abs((l_extendedprice - m) / sd) > 3 THEN 1 END) AS BIGINT) AS z_outliers,
       CAST(count(CASE WHEN l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)
                  THEN 1 END) AS BIGINT) AS iqr_outliers,
       CAST(count(*) AS BIGINT) AS n
FROM line_spikes, s""")
def q_outlier_counts(spark, sf):
    return profile.outlier_counts(T.line_spikes(spark, sf), "l_extendedprice")


@register("outlier_points", f"""
WITH {SQL_EG}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events_gaps)
SELECT event_id, round(value, 6) AS value, round((value - m) / sd, 6) AS z, abs((value - m) / sd) > 3 AS is_outlier
FROM events_gaps, s WHERE value IS NOT NULL""")
def q_outlier_points(spark, sf):
    return r6(profile.outlier_points(T.events_gaps(spark, sf), "value", ["event_id"]))


@register("top_categories", """
SELECT p_brand AS value, CAST(count(*) AS BIGINT) AS count FROM part
GROUP BY p_brand ORDER BY count DESC, value LIMIT 20""")
def q_top_categories(spark, sf):
    return profile.top_categories(T.table(spark, sf, "part"), "p_brand", 20)


@register("auto_remove", """
WITH u AS (
  SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS "unique" FROM customer
  UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer
  UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer
  UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer
  UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer),
n AS (SELECT count(*) AS rows FROM customer)
SELECT "column", CAST("unique" AS BIGINT) AS "unique", CAST(rows AS BIGINT) AS rows FROM u, n
WHERE "unique" = rows OR "unique" <= 1""")
def q_auto_remove(spark, sf):
    return profile.auto_remove(T.table(spark, sf, "customer"))


@register("low_variance", f"""
WITH {SQL_PW},
v AS (
  SELECT 'p_partkey' AS "column", var_pop(CAST(coalesce(p_partkey, 0) AS DOUBLE)) AS variance FROM part_wide
  UNION ALL SELECT 'p_size', var_pop(CAST(coalesce(p_size, 0) AS DOUBLE)) FROM part_wide
  UNION ALL SELECT 'p_retailprice', var_pop(coalesce(p_retailprice, 0)) FROM part_wide
  UNION ALL SELECT 'size_x_price', var_pop(coalesce(size_x_price, 0)) FROM part_wide
  UNION ALL SELECT 'const5', var_pop(coalesce(const5, 0)) FROM part_wide)
SELECT "column", round(variance, 6) AS variance FROM v
WHERE variance < 0.01 AND (SELECT max(variance) FROM v) > 0.01""")
def q_low_variance(spark, sf):
    return r6(profile.low_variance(T.part_wide(spark, sf), 0.01))


@register("dropna_impact", f"""
WITH {SQL_EG}
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(count(CASE WHEN event_type IS NOT NULL AND value IS NOT NULL THEN 1 END) AS BIGINT) AS rows_after,
       round(count(CASE WHEN event_type IS NOT NULL AND value IS NOT NULL THEN 1 END) * 100.0 / count(*), 6) AS pct_kept,
       count(CASE WHEN event_type IS NOT NULL AND value IS NOT NULL THEN 1 END) < 50
         OR count(CASE WHEN event_type IS NOT NULL AND value IS NOT NULL THEN 1 END) * 100.0 / count(*) < 30 AS warn
FROM events_gaps""")
def q_dropna_impact(spark, sf):
    return r6(profile.dropna_impact(T.events_gaps(spark, sf)))


@register("keep_columns", """
SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_keep_columns(spark, sf):
    """Default selection: every column minus the auto-remove suggestions
    (unique per row or constant). c_acctbal is not unique at sf0.01."""
    cust = T.table(spark, sf, "customer")
    drop = {r["column"] for r in profile.auto_remove(cust).collect()}
    keep = [c for c in cust.columns if c not in drop]
    if not keep:
        raise ValueError("no column left to keep")
    return cust.select(*keep)


@register("select_features", f"""
WITH {SQL_PW}
SELECT p_partkey, p_size, p_retailprice, size_x_price, p_type FROM part_wide""")
def q_select_features(spark, sf):
    """Default feature selection: every column minus the low-variance ones."""
    pw = T.part_wide(spark, sf)
    low = {r["column"] for r in profile.low_variance(pw).collect()}
    return pw.select(*[c for c in pw.columns if c not in low])


# ================================================================ cleaning

@register("impute_mean", f"""
WITH {SQL_EG}
SELECT event_id, user_id, coalesce(event_type, 'Missing') AS event_type,
       round(coalesce(value, (SELECT avg(value) FROM events_gaps)), 6) AS value
FROM events_gaps""")
def q_impute_mean(spark, sf):
    return r6(clean.impute(T.events_gaps(spark, sf), "Mean", exclude=["event_id"]))


@register("impute_median", f"""
WITH {SQL_PG}
SELECT p_partkey,
       round(coalesce(CAST(p_size AS DOUBLE), (SELECT quantile_cont(p_size, 0.5) FROM part_gaps)), 6) AS p_size,
       round(coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM part_gaps)), 6) AS p_retailprice,
       coalesce(p_type, 'Missing') AS p_type
FROM part_gaps""")
def q_impute_median(spark, sf):
    return r6(clean.impute(T.part_gaps(spark, sf), "Median", exclude=["p_partkey"]))


@register("impute_knn_clean", f"""
WITH {SQL_PG}
SELECT p_partkey,
       round(coalesce(CAST(p_size AS DOUBLE), (SELECT avg(p_size) FROM part_gaps)), 6) AS p_size,
       round(coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM part_gaps)), 6) AS p_retailprice,
       coalesce(p_type, 'Missing') AS p_type
FROM part_gaps""")
def q_impute_knn_clean(spark, sf):
    return r6(clean.impute(T.part_gaps(spark, sf), "KNN", exclude=["p_partkey"]))


@register("impute_cat", f"""
WITH {SQL_EG}
SELECT event_id, coalesce(event_type, 'Missing') AS event_type FROM events_gaps""")
def q_impute_cat(spark, sf):
    return clean.fill_categorical(T.events_gaps(spark, sf).select("event_id", "event_type"))


@register("drop_rows", f"""
WITH {SQL_EG}
SELECT * FROM events_gaps WHERE event_type IS NOT NULL AND value IS NOT NULL""")
def q_drop_rows(spark, sf):
    return clean.drop_rows(T.events_gaps(spark, sf))


LN_VALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LN_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("outlier_zscore", f"""
WITH {SQL_LS},
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LN_VALS)} FROM line_spikes)
SELECT line_spikes.* FROM line_spikes, s
WHERE {" AND ".join(f"abs(({c} - m_{c}) / s_{c}) < 3" for c in LN_VALS)}""")
def q_outlier_zscore(spark, sf):
    return clean.zscore_filter(T.line_spikes(spark, sf), exclude=LN_KEYS)


@register("outlier_iqr", f"""
WITH {SQL_LS},
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in LN_VALS)}
      FROM line_spikes)
SELECT line_spikes.* FROM line_spikes, q
WHERE {" AND ".join(f"{c} >= a_{c} - 1.5 * (b_{c} - a_{c}) AND {c} <= b_{c} + 1.5 * (b_{c} - a_{c})" for c in LN_VALS)}""")
def q_outlier_iqr(spark, sf):
    return clean.iqr_filter(T.line_spikes(spark, sf), exclude=LN_KEYS)


@register("outlier_clip", f"""
WITH {SQL_LN},
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.01) AS a_{c}, quantile_cont({c}, 0.99) AS b_{c}" for c in LN_VALS)}
      FROM line_num)
SELECT {", ".join(LN_KEYS)}, {", ".join(f"round(greatest(least({c}, b_{c}), a_{c}), 6) AS {c}" for c in LN_VALS)}
FROM line_num, q""")
def q_outlier_clip(spark, sf):
    return r6(clean.clip_percentiles(T.line_num(spark, sf), exclude=LN_KEYS))


@register("clean_job", f"""
WITH {SQL_PS},
kept AS (SELECT p_size, p_retailprice, p_type FROM part_spikes),
imp AS (SELECT coalesce(CAST(p_size AS DOUBLE), (SELECT quantile_cont(p_size, 0.5) FROM kept)) AS p_size,
               coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM kept)) AS p_retailprice,
               coalesce(p_type, 'Missing') AS p_type FROM kept),
q AS (SELECT quantile_cont(p_size, 0.25) AS a1, quantile_cont(p_size, 0.75) AS b1,
             quantile_cont(p_retailprice, 0.25) AS a2, quantile_cont(p_retailprice, 0.75) AS b2 FROM imp)
SELECT round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice, p_type FROM imp, q
WHERE p_size BETWEEN a1 - 1.5 * (b1 - a1) AND b1 + 1.5 * (b1 - a1)
  AND p_retailprice BETWEEN a2 - 1.5 * (b2 - a2) AND b2 + 1.5 * (b2 - a2)""")
def q_clean_job(spark, sf):
    from tessera.plans.clean_job import CleanConfig, run_clean
    return r6(run_clean(T.part_spikes(spark, sf), CleanConfig(imputation="Median", outliers="IQR")))


# ================================================================ features

@register("ratio_feature", """
SELECT c_custkey, round(c_acctbal / (nullif(CAST(c_nationkey AS DOUBLE), 0) + 1e-9), 6) AS c_acctbal_per_c_nationkey
FROM customer""")
def q_ratio_feature(spark, sf):
    c = T.table(spark, sf, "customer")
    return r6(features.ratio_feature(c, "c_acctbal", "c_nationkey").select("c_custkey", "c_acctbal_per_c_nationkey"))


@register("interaction_feature", """
SELECT p_partkey, round(CAST(p_size AS DOUBLE) * p_retailprice, 6) AS p_size_x_p_retailprice FROM part""")
def q_interaction_feature(spark, sf):
    p = T.table(spark, sf, "part")
    return r6(features.interaction_feature(p, "p_size", "p_retailprice").select("p_partkey", "p_size_x_p_retailprice"))


@register("pca_explained_2d", f"""
WITH {SQL_CF},
r AS (SELECT abs(covar_pop(acctbal, avg_total) / (stddev_pop(acctbal) * stddev_pop(avg_total))) AS r
      FROM customer_features)
SELECT 1 AS component, round((1 + r) / 2 * 100, 6) AS individual_pct, round((1 + r) / 2 * 100, 6) AS cumulative_pct FROM r
UNION ALL
SELECT 2, round((1 - r) / 2 * 100, 6), round(100.0, 6) FROM r""")
def q_pca_explained_2d(spark, sf):
    cf = T.customer_features(spark, sf)
    return r6(features.pca_explained(cf, ["acctbal", "avg_total"]))


# ================================================================ encoding

PW_SCALE = ["p_size", "p_retailprice", "size_x_price", "const5"]


@register("scale_standard", f"""
WITH {SQL_PW}, s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) = max({c}) AS k_{c}" for c in PW_SCALE)} FROM part_wide)
SELECT p_partkey, {", ".join(f"round(CASE WHEN k_{c} THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END, 6) AS {c}" for c in PW_SCALE)}
FROM part_wide, s""")
def q_scale_standard(spark, sf):
    pw = T.part_wide(spark, sf).select("p_partkey", *PW_SCALE)
    return r6(encode.scale(pw, PW_SCALE, "StandardScaler"))


@register("scale_minmax", f"""
WITH {SQL_PW}, s AS (SELECT {", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in PW_SCALE)} FROM part_wide)
SELECT p_partkey, {", ".join(f"round(CASE WHEN a_{c} = b_{c} THEN 0.0 ELSE ({c} - a_{c}) / (b_{c} - a_{c}) END, 6) AS {c}" for c in PW_SCALE)}
FROM part_wide, s""")
def q_scale_minmax(spark, sf):
    pw = T.part_wide(spark, sf).select("p_partkey", *PW_SCALE)
    return r6(encode.scale(pw, PW_SCALE, "MinMaxScaler"))


@register("scale_robust", f"""
WITH {SQL_PW}, s AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}" for c in PW_SCALE)} FROM part_wide)
SELECT p_partkey, {", ".join(f"round(({c} - m_{c}) / CASE WHEN i_{c} = 0 THEN 1.0 ELSE i_{c} END, 6) AS {c}" for c in PW_SCALE)}
FROM part_wide, s""")
def q_scale_robust(spark, sf):
    pw = T.part_wide(spark, sf).select("p_partkey", *PW_SCALE)
    return r6(encode.scale(pw, PW_SCALE, "RobustScaler"))


@register("one_hot", """
WITH cats AS (SELECT DISTINCT coalesce(p_type, 'Missing') AS v FROM part)
SELECT p.p_partkey, 'p_type_' || cats.v AS feature,
       CASE WHEN coalesce(p.p_type, 'Missing') = cats.v THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS value
FROM part p CROSS JOIN cats""")
def q_one_hot(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_type")
    wide = encode.one_hot(p, ["p_type"])
    feats = [c for c in wide.columns if c != "p_partkey"]
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("value")) for c in feats]
    return wide.select("p_partkey", F.explode(F.array(*structs)).alias("r")).select("p_partkey", "r.feature", "r.value")


@register("assemble_features", f"""
WITH {SQL_EG},
st AS (SELECT avg(CAST(user_id AS DOUBLE)) AS mu, stddev_pop(CAST(user_id AS DOUBLE)) AS su,
              avg(value) AS mv FROM events_gaps),
imp AS (SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, coalesce(value, mv) AS value,
               coalesce(event_type, 'Missing') AS event_type, mu, su FROM events_gaps, st),
st2 AS (SELECT avg(value) AS m2, stddev_pop(value) AS s2 FROM imp),
cats AS (SELECT event_type AS v, CAST(row_number() OVER (ORDER BY event_type) + 1 AS INTEGER) AS pos
         FROM (SELECT DISTINCT event_type FROM imp))
SELECT event_id, 0 AS pos, 'user_id' AS feature, round((user_id - mu) / su, 6) AS value FROM imp
UNION ALL SELECT event_id, 1, 'value', round((value - m2) / s2, 6) FROM imp, st2
UNION ALL SELECT event_id, cats.pos, 'event_type_' || cats.v, CASE WHEN imp.event_type = cats.v THEN 1.0 ELSE 0.0 END
          FROM imp CROSS JOIN cats""")
def q_assemble_features(spark, sf):
    enc = encode.preprocess(T.events_gaps(spark, sf), ["event_id"], "StandardScaler", "Mean")
    names = F.array(*[F.lit(n) for n in enc.feature_names])
    return r6(enc.frame.select("event_id", F.posexplode("x").alias("pos", "value"))
              .select("event_id", "pos", names[F.col("pos")].alias("feature"), "value"))


PG_NUM = ["p_size", "p_retailprice"]


@register("impute_knn", f"""
WITH {SQL_PG},
pts AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part_gaps),
cand AS (
  SELECT r.k, 0 AS ci, d.k AS dk, d.a AS v,
         CASE WHEN r.b IS NOT NULL AND d.b IS NOT NULL THEN 2.0 / 1.0 * ((r.b - d.b) * (r.b - d.b)) END AS d2
  FROM pts r JOIN pts d ON r.a IS NULL AND d.a IS NOT NULL
  UNION ALL
  SELECT r.k, 1 AS ci, d.k, d.b,
         CASE WHEN r.a IS NOT NULL AND d.a IS NOT NULL THEN 2.0 / 1.0 * ((r.a - d.a) * (r.a - d.a)) END
  FROM pts r JOIN pts d ON r.b IS NULL AND d.b IS NOT NULL),
top AS (SELECT k, ci, avg(v) AS fill FROM (
          SELECT k, ci, v, row_number() OVER (PARTITION BY k, ci ORDER BY d2, dk) AS rn FROM cand WHERE d2 IS NOT NULL)
        WHERE rn <= 5 GROUP BY k, ci)
SELECT p.k AS p_partkey,
       round(coalesce(p.a, ta.fill, (SELECT avg(a) FROM pts)), 6) AS p_size,
       round(coalesce(p.b, tb.fill, (SELECT avg(b) FROM pts)), 6) AS p_retailprice
FROM pts p LEFT JOIN top ta ON ta.k = p.k AND ta.ci = 0 LEFT JOIN top tb ON tb.k = p.k AND tb.ci = 1""")
def q_impute_knn(spark, sf):
    from tessera.operators.knn import knn_impute
    pg = T.part_gaps(spark, sf).select("p_partkey", *PG_NUM)
    return r6(knn_impute(pg, ["p_partkey"], PG_NUM, k=5))


# ================================================================ DBSCAN

SQL_CF_DB = ",\n".join([SQL_CF, sql_zscore("customer_features", "c_custkey", CF_COLS, "cz"),
                        sql_dbscan("cz", "c_custkey", CF_COLS, EPS_CF_001, 5, "clab")])


@register("dbscan_labels", f"""
WITH RECURSIVE {SQL_CF_DB}
SELECT c_custkey, cluster FROM clab""")
def q_dbscan_labels(spark, sf):
    return _cf_labels(spark, sf)


@register("dbscan_core", f"""
WITH RECURSIVE {SQL_CF_DB}
SELECT i AS c_custkey, CAST(count(*) AS BIGINT) AS n_neighbors FROM clab_nb GROUP BY i HAVING count(*) >= 5""")
def q_dbscan_core(spark, sf):
    from tessera.operators.dbscan import neighbour_counts
    cf = T.customer_features(spark, sf)
    enc = encode.preprocess(cf, ["c_custkey"], "StandardScaler", "Mean")
    return neighbour_counts(enc.frame, "c_custkey", EPS_CF_001).where(F.col("n_neighbors") >= 5)


@register("cluster_counts", f"""
WITH RECURSIVE {SQL_CF_DB}
SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS clusters,
       CAST(count(CASE WHEN cluster = -1 THEN 1 END) AS BIGINT) AS noise FROM clab""")
def q_cluster_counts(spark, sf):
    return quality.cluster_counts(_cf_labels(spark, sf))


# ================================================================ metrics

SQL_EL_LONG = f"""{SQL_EL},
el AS (SELECT vec_id, cluster, unnest(x) AS v, unnest(generate_series(1, len(x))) AS pos FROM embed_labelled)"""


@register("silhouette", f"""
WITH {SQL_EL_LONG},
d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist
      FROM el a JOIN el b ON a.pos = b.pos GROUP BY a.vec_id, b.vec_id),
lab AS (SELECT vec_id, cluster FROM embed_labelled),
sz AS (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster),
pc AS (SELECT d.i, lb.cluster AS pc, sum(d.dist) AS s FROM d JOIN lab lb ON d.j = lb.vec_id GROUP BY d.i, lb.cluster),
ab AS (SELECT pc.i, max(CASE WHEN pc.pc = la.cluster THEN pc.s / (sz.n - 1) END) AS a,
              min(CASE WHEN pc.pc <> la.cluster THEN pc.s / sz.n END) AS b,
              max(CASE WHEN pc.pc = la.cluster THEN sz.n END) AS own_n
       FROM pc JOIN lab la ON pc.i = la.vec_id JOIN sz ON sz.cluster = pc.pc GROUP BY pc.i)
SELECT round(avg(CASE WHEN own_n <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM ab""")
def q_silhouette(spark, sf):
    return r6(quality.silhouette(T.embed_labelled(spark, sf), "vec_id"))


@register("davies_bouldin", f"""
WITH {SQL_EL_LONG},
c AS (SELECT cluster, pos, avg(v) AS cv FROM el GROUP BY cluster, pos),
s AS (SELECT cluster, avg(dd) AS s FROM (
        SELECT el.vec_id, el.cluster, sqrt(sum((el.v - c.cv) * (el.v - c.cv))) AS dd
        FROM el JOIN c ON el.cluster = c.cluster AND el.pos = c.pos GROUP BY el.vec_id, el.cluster) GROUP BY cluster),
m AS (SELECT a.cluster AS ca, b.cluster AS cb, sqrt(sum((a.cv - b.cv) * (a.cv - b.cv))) AS m
      FROM c a JOIN c b ON a.pos = b.pos AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
r AS (SELECT ca, max((sa.s + sb.s) / m) AS r FROM m JOIN s sa ON sa.cluster = ca JOIN s sb ON sb.cluster = cb GROUP BY ca)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def q_davies_bouldin(spark, sf):
    return r6(quality.davies_bouldin(T.embed_labelled(spark, sf), "vec_id"))


@register("calinski_harabasz", f"""
WITH {SQL_EL_LONG},
c AS (SELECT cluster, pos, avg(v) AS cv, count(*) AS n FROM el GROUP BY cluster, pos),
g AS (SELECT pos, avg(v) AS gv FROM el GROUP BY pos),
w AS (SELECT sum((el.v - c.cv) * (el.v - c.cv)) AS w FROM el JOIN c ON el.cluster = c.cluster AND el.pos = c.pos),
b AS (SELECT sum(c.n * (c.cv - g.gv) * (c.cv - g.gv)) AS b FROM c JOIN g ON c.pos = g.pos),
k AS (SELECT count(DISTINCT cluster) AS k, count(*) AS n FROM embed_labelled)
SELECT round(CASE WHEN w = 0 THEN 1.0 ELSE b * (n - k) / (w * (k - 1)) END, 6) AS calinski_harabasz FROM w, b, k""")
def q_calinski_harabasz(spark, sf):
    return r6(quality.calinski_harabasz(T.embed_labelled(spark, sf), "vec_id"))


# ================================================================ KMeans pieces

def _label_centres(spark, sf):
    el = T.embed_labelled(spark, sf)
    dim = 64
    rows = (el.groupBy("cluster").agg(*[F.avg(F.col("x")[i]).alias(f"c{i}") for i in range(dim)])
            .orderBy("cluster").collect())
    return el, [r["cluster"] for r in rows], [[r[f"c{i}"] for i in range(dim)] for r in rows]


@register("kmeans_assign", f"""
WITH {SQL_EL_LONG},
c AS (SELECT cluster AS ci, pos, avg(v) AS cv FROM el GROUP BY cluster, pos),
d AS (SELECT el.vec_id, c.ci, sum((el.v - c.cv) * (el.v - c.cv)) AS d2 FROM el JOIN c ON el.pos = c.pos
      GROUP BY el.vec_id, c.ci)
SELECT vec_id, CAST(ci AS INTEGER) AS cluster FROM (
  SELECT vec_id, ci, row_number() OVER (PARTITION BY vec_id ORDER BY d2, ci) AS rn FROM d) WHERE rn = 1""")
def q_kmeans_assign(spark, sf):
    el, labels, centres = _label_centres(spark, sf)
    lab_of = F.array(*[F.lit(int(v)) for v in labels])
    return kmeans.assign(el, centres).select("vec_id", lab_of[F.col("cluster")].cast("int").alias("cluster"))


@register("lloyd_step", f"""
WITH {SQL_EL_LONG},
c AS (SELECT cluster AS ci, pos, avg(v) AS cv FROM el GROUP BY cluster, pos),
d AS (SELECT el.vec_id, c.ci, sum((el.v - c.cv) * (el.v - c.cv)) AS d2 FROM el JOIN c ON el.pos = c.pos
      GROUP BY el.vec_id, c.ci),
a AS (SELECT vec_id, ci FROM (SELECT vec_id, ci, row_number() OVER (PARTITION BY vec_id ORDER BY d2, ci) AS rn FROM d)
      WHERE rn = 1)
SELECT CAST(a.ci AS INTEGER) AS cluster, CAST(el.pos - 1 AS INTEGER) AS pos, round(avg(el.v), 6) AS value
FROM a JOIN el ON a.vec_id = el.vec_id GROUP BY a.ci, el.pos""")
def q_lloyd_step(spark, sf):
    el, labels, centres = _label_centres(spark, sf)
    step = kmeans.lloyd_step(el, centres)
    lab_of = F.array(*[F.lit(int(v)) for v in labels])
    return r6(step.select(lab_of[F.col("cluster")].cast("int").alias("cluster"),
                          F.posexplode(F.array(*[F.col(f"c{i}") for i in range(64)])).alias("pos", "value")))


@register("inertia", f"""
WITH {SQL_EL_LONG},
c AS (SELECT cluster AS ci, pos, avg(v) AS cv FROM el GROUP BY cluster, pos),
d AS (SELECT el.vec_id, c.ci, sum((el.v - c.cv) * (el.v - c.cv)) AS d2 FROM el JOIN c ON el.pos = c.pos
      GROUP BY el.vec_id, c.ci)
SELECT round(sum(m), 6) AS inertia FROM (SELECT vec_id, min(d2) AS m FROM d GROUP BY vec_id)""")
def q_inertia(spark, sf):
    el, _, centres = _label_centres(spark, sf)
    return r6(kmeans.inertia(el, centres))


# ================================================================ results

@register("label_join", f"""
WITH RECURSIVE {SQL_CF_DB}
SELECT c.c_custkey, c.c_name, c.c_mktsegment, l.cluster FROM customer c JOIN clab l ON c.c_custkey = l.c_custkey""")
def q_label_join(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return results.label_join(c, _cf_labels(spark, sf), ["c_custkey"])


@register("cluster_sizes", f"""
WITH RECURSIVE {SQL_UF_LAB}
SELECT cluster, CAST(count(*) AS BIGINT) AS count FROM labelled GROUP BY cluster""")
def q_cluster_sizes(spark, sf):
    return results.cluster_sizes(_uf_labelled(spark, sf))


@register("cluster_share", f"""
WITH RECURSIVE {SQL_UF_LAB}
SELECT cluster, CAST(count(*) AS BIGINT) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM labelled), 6) AS pct
FROM labelled GROUP BY cluster""")
def q_cluster_share(spark, sf):
    return r6(results.cluster_share(_uf_labelled(spark, sf)))


@register("cluster_profile", f"""
WITH RECURSIVE {SQL_UF_LAB}
SELECT cluster, {", ".join(f"round(avg({c}), 6) AS {c}" for c in UF_COLS)} FROM labelled GROUP BY cluster""")
def q_cluster_profile(spark, sf):
    return r6(results.cluster_profile(_uf_labelled(spark, sf), ["user_id"]))


SQL_UF_LONG = SQL_UF_LAB + ",\n" + "prof AS (" + "\nUNION ALL\n".join(
    f"SELECT cluster, '{c}' AS feature, avg({c}) AS mean FROM labelled GROUP BY cluster" for c in UF_COLS) + ")"


@register("radar_series", f"""
WITH RECURSIVE {SQL_UF_LONG}
SELECT cluster, feature, round(mean, 6) AS mean FROM prof""")
def q_radar_series(spark, sf):
    return r6(results.profile_long(_uf_labelled(spark, sf), ["user_id"]))


@register("feature_importance", f"""
WITH RECURSIVE {SQL_UF_LONG}
SELECT feature, round(max(mean) - min(mean), 6) AS spread FROM prof GROUP BY feature
ORDER BY max(mean) - min(mean) DESC, feature LIMIT 10""")
def q_feature_importance(spark, sf):
    return r6(results.feature_importance(_uf_labelled(spark, sf), ["user_id"]))


@register("cluster_heatmap", f"""
WITH RECURSIVE {SQL_UF_LONG}
SELECT cluster, feature,
       round((mean - min(mean) OVER (PARTITION BY feature))
             / (max(mean) OVER (PARTITION BY feature) - min(mean) OVER (PARTITION BY feature) + 1e-9), 6) AS norm
FROM prof""")
def q_cluster_heatmap(spark, sf):
    return r6(results.cluster_heatmap(_uf_labelled(spark, sf), ["user_id"]))


@register("pair_scatter", f"""
WITH RECURSIVE {SQL_UF_LAB}
SELECT user_id, round(n, 6) AS n, round(avg_value, 6) AS avg_value, round(error_rate, 6) AS error_rate, cluster
FROM labelled""")
def q_pair_scatter(spark, sf):
    return r6(results.pair_scatter(_uf_labelled(spark, sf), ["user_id"]))


@register("cluster_describe", f"""
WITH RECURSIVE {SQL_UF_LAB}
""" + "\nUNION ALL\n".join(
    f"""SELECT cluster, '{c}' AS feature, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max
FROM labelled GROUP BY cluster""" for c in UF_COLS))
def q_cluster_describe(spark, sf):
    return r6(results.cluster_describe(_uf_labelled(spark, sf), ["user_id"]))


def _descr_sql() -> str:
    above = " , ".join(f"CASE WHEN p.{c} > o.{c} * 1.1 THEN '{c}' END" for c in UF_COLS)
    below = " , ".join(f"CASE WHEN p.{c} < o.{c} * 0.9 THEN '{c}' END" for c in UF_COLS)
    return f"""
WITH RECURSIVE {SQL_UF_LAB},
o AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in UF_COLS)} FROM labelled),
p AS (SELECT cluster, count(*) AS cnt, {", ".join(f"avg({c}) AS {c}" for c in UF_COLS)} FROM labelled GROUP BY cluster),
t AS (SELECT p.cluster, p.cnt, list_filter([{above}], lambda x: x IS NOT NULL) AS ab,
             list_filter([{below}], lambda x: x IS NOT NULL) AS be FROM p, o),
u AS (SELECT cluster, cnt, list_filter([
        CASE WHEN len(ab) > 0 THEN 'above-average ' || array_to_string(ab[1:3], ', ') END,
        CASE WHEN len(be) > 0 THEN 'below-average ' || array_to_string(be[1:3], ', ') END], lambda x: x IS NOT NULL) AS parts
      FROM t)
SELECT cluster, CAST(cnt AS BIGINT) AS n, round(cnt * 100.0 / (SELECT count(*) FROM labelled), 6) AS pct,
       CASE WHEN cluster = -1 THEN '{results.NOISE_TEXT}'
            WHEN len(parts) > 0 THEN array_to_string(parts, '; ')
            ELSE 'near-average across all features' END AS description
FROM u"""


@register("cluster_descriptions", _descr_sql())
def q_cluster_descriptions(spark, sf):
    return r6(results.cluster_descriptions(_uf_labelled(spark, sf), ["user_id"]))


# ================================================================ search

@register("deterministic_sample", f"""
WITH {SQL_CF}
SELECT c_custkey, acctbal, n_orders, round(avg_total, 6) AS avg_total FROM customer_features
ORDER BY md5('42-' || CAST(c_custkey AS VARCHAR)) LIMIT 500""")
def q_deterministic_sample(spark, sf):
    from tessera.plans.search import deterministic_sample
    return r6(deterministic_sample(T.customer_features(spark, sf), "c_custkey", 500, seed=42))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import catalog_models  # noqa: F401 - registers its queries
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from tessera.plans import catalog_models  # noqa: F401
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}


# ================================================================ clustering jobs

def _uf_x(spark, sf):
    uf = T.user_features(spark, sf)
    return encode.preprocess(uf, ["user_id"], "StandardScaler", "Mean").frame


def _cf_x(spark, sf):
    cf = T.customer_features(spark, sf)
    return encode.preprocess(cf, ["c_custkey"], "StandardScaler", "Mean").frame


HEIGHT_UF = 0.5


@register("single_linkage", f"""
WITH RECURSIVE {SQL_UF},
{sql_zscore("user_features", "user_id", UF_COLS, "uz")},
{sql_dbscan("uz", "user_id", UF_COLS, HEIGHT_UF, 1, "sl")}
SELECT user_id, cluster FROM sl""")
def q_single_linkage(spark, sf):
    """Single-linkage clusters cut at height 0.5 (components of the 0.5-graph)."""
    from tessera.operators.agglomerative import single_linkage_at
    return single_linkage_at(_uf_x(spark, sf), "user_id", HEIGHT_UF)


def _agglo(linkage):
    def run(spark, sf):
        from tessera.operators.agglomerative import agglomerative
        return agglomerative(_uf_x(spark, sf), "user_id", k=3, linkage=linkage)
    return run


register("agglomerative_ward")(_agglo("ward"))
register("agglomerative_complete")(_agglo("complete"))
register("agglomerative_average")(_agglo("average"))


@register("dendrogram")
def q_dendrogram(spark, sf):
    from tessera.operators.agglomerative import dendrogram
    return r6(dendrogram(_uf_x(spark, sf), "user_id", "ward"))


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    return kmeans.kmeans(_cf_x(spark, sf), "c_custkey", k=3)


@register("elbow")
def q_elbow(spark, sf):
    return r6(kmeans.elbow(_cf_x(spark, sf), "c_custkey", max_k=10))


@register("silhouette_sweep")
def q_silhouette_sweep(spark, sf):
    from tessera.plans.search import silhouette_sweep
    return r6(silhouette_sweep(_uf_x(spark, sf), "user_id", max_k=10))


@register("pca_project_2d")
def q_pca_project_2d(spark, sf):
    enc = encode.preprocess(T.customer_features(spark, sf), ["c_custkey"], "StandardScaler", "Mean")
    return r6(features.pca_project_2d(enc.frame, ["c_custkey"], enc.dim))


@register("pca_explained")
def q_pca_explained(spark, sf):
    return r6(features.pca_explained(T.line_num(spark, sf), LN_VALS))


def _search_counts_sql() -> str:
    parts, ctes = [], []
    for i, eps in enumerate((0.2, 0.4, 0.6, 0.8, 1.0)):
        ctes.append(sql_dbscan("uz", "user_id", UF_COLS, eps, 5, f"s{i}"))
        parts.append(f"SELECT CAST({eps} AS DOUBLE) AS eps, CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) "
                     f"AS clusters, CAST(count(CASE WHEN cluster = -1 THEN 1 END) AS BIGINT) AS noise FROM s{i}")
    return (f"WITH RECURSIVE {SQL_UF},\n{sql_zscore('user_features', 'user_id', UF_COLS, 'uz')},\n"
            + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts))


@register("automl_dbscan_counts", _search_counts_sql())
def q_automl_dbscan_counts(spark, sf):
    """The DBSCAN part of the search grid: clusters and noise per eps."""
    from tessera.operators.dbscan import dbscan_multi
    from tessera.plans.search import DBSCAN_EPS, DBSCAN_MIN_SAMPLES
    multi = dbscan_multi(_uf_x(spark, sf), "user_id", list(DBSCAN_EPS), DBSCAN_MIN_SAMPLES)
    return multi.groupBy("eps").agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"),
        F.count(F.when(F.col("cluster") == -1, 1)).alias("noise"))


@register("automl_rank")
def q_automl_rank(spark, sf):
    from tessera.plans.search import run_search
    ranked, _, _ = run_search(_uf_x(spark, sf), "user_id", n_km=8)
    return ranked


def _metrics_sql(lab: str, src: str, key: str, cols: list[str]) -> str:
    d = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    dc = " + ".join(f"(v.{c} - c.{c}) * (v.{c} - c.{c})" for c in cols)
    dcc = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    dg = " + ".join(f"(c.{c} - g.{c}) * (c.{c} - g.{c})" for c in cols)
    return f"""v AS (SELECT z.*, l.cluster FROM {src} z JOIN {lab} l USING ({key}) WHERE l.cluster <> -1),
sz AS (SELECT cluster, count(*) AS n FROM v GROUP BY cluster),
pc AS (SELECT a.{key} AS i, a.cluster AS own, b.cluster AS pc, sum(sqrt({d})) AS s
       FROM v a JOIN v b ON true GROUP BY a.{key}, a.cluster, b.cluster),
ab AS (SELECT i, max(CASE WHEN pc.pc = own THEN s / (sz.n - 1) END) AS a, min(CASE WHEN pc.pc <> own THEN s / sz.n END) AS b,
              max(CASE WHEN pc.pc = own THEN sz.n END) AS own_n FROM pc JOIN sz ON sz.cluster = pc.pc GROUP BY i),
sil AS (SELECT avg(CASE WHEN own_n <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab),
c AS (SELECT cluster, count(*) AS n_rows, {", ".join(f"avg({c}) AS {c}" for c in cols)} FROM v GROUP BY cluster),
g AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in cols)} FROM v),
intra AS (SELECT v.cluster, avg(sqrt({dc})) AS s, sum({dc}) AS w FROM v JOIN c USING (cluster) GROUP BY v.cluster),
dbr AS (SELECT a.cluster, max((ia.s + ib.s) / sqrt({dcc})) AS r FROM c a JOIN c b ON a.cluster <> b.cluster
        JOIN intra ia ON ia.cluster = a.cluster JOIN intra ib ON ib.cluster = b.cluster GROUP BY a.cluster),
db AS (SELECT avg(r) AS davies_bouldin FROM dbr),
ch AS (SELECT CASE WHEN (SELECT sum(w) FROM intra) = 0 THEN 1.0 ELSE
          (SELECT sum(c.n_rows * ({dg})) FROM c, g) * ((SELECT count(*) FROM v) - (SELECT count(*) FROM c))
          / ((SELECT sum(w) FROM intra) * ((SELECT count(*) FROM c) - 1)) END AS calinski_harabasz),
cnt AS (SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS clusters,
               CAST(count(CASE WHEN cluster = -1 THEN 1 END) AS BIGINT) AS noise FROM {lab})"""


def _search_scores_sql() -> str:
    eps_list = (0.2, 0.4, 0.6, 0.8, 1.0)
    ctes = [sql_dbscan("uz", "user_id", UF_COLS, eps, 5, f"s{i}") for i, eps in enumerate(eps_list)]
    parts = []
    for i, eps in enumerate(eps_list):
        # every configuration has its own names for the metric tables
        ctes.append(re.sub(r"\b(v|sz|pc|ab|sil|c|g|intra|dbr|db|ch|cnt)\b", rf"\1_{i}", _metrics_sql(f"s{i}", "uz", "user_id", UF_COLS)))
        parts.append(f"""SELECT CAST({eps} AS DOUBLE) AS eps, coalesce(nullif(round(silhouette, 4), 0), -1.0) AS silhouette,
       coalesce(nullif(round(davies_bouldin, 4), 0), 999.0) AS davies_bouldin, clusters FROM cnt_{i}, sil_{i}, db_{i} WHERE clusters >= 2""")
    return (f"WITH RECURSIVE {SQL_UF},\n{sql_zscore('user_features', 'user_id', UF_COLS, 'uz')},\n"
            + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts))


@register("automl_dbscan_scores", _search_scores_sql())
def q_automl_dbscan_scores(spark, sf):
    """The scores of the search's DBSCAN configurations, over all rows."""
    from tessera.plans.search import config_grid, evaluate
    configs = [c for c in config_grid(8) if c.algorithm == "DBSCAN"]
    eps = F.create_map(*[v for c in configs for v in (F.lit(c.ordinal), F.lit(float(c.params["eps"])))])
    return evaluate(_uf_x(spark, sf), "user_id", configs).select(eps[F.col("ordinal")].alias("eps"), "silhouette", "davies_bouldin", "clusters")


@register("train_dbscan_e2e", f"""
WITH RECURSIVE {SQL_CF_DB},
{_metrics_sql("clab", "cz", "c_custkey", CF_COLS)}
SELECT clusters, noise, round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin,
       round(calinski_harabasz, 6) AS calinski_harabasz FROM cnt, sil, db, ch""")
def q_train_dbscan_e2e(spark, sf):
    """Train job: preprocess (mean, standard) -> DBSCAN(0.4, 5) -> all metrics."""
    from tessera.plans.train import train
    res = train(T.customer_features(spark, sf), "c_custkey", "DBSCAN", {"eps": EPS_CF_001, "min_samples": 5})
    return r6(res.metrics)


# ================================================================ sources, report, stream

@register("csv_infer", f"""
WITH {SQL_EG},
s AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
             CAST(value AS VARCHAR) AS value FROM events_gaps)
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CASE
      WHEN count({c}) = 0 THEN 'double'
      WHEN count(CASE WHEN {c} IS NOT NULL AND TRY_CAST(trim({c}) AS BIGINT) IS NULL THEN 1 END) = 0
        THEN CASE WHEN count({c}) = count(*) THEN 'bigint' ELSE 'double' END
      WHEN count(CASE WHEN {c} IS NOT NULL AND TRY_CAST(trim({c}) AS DOUBLE) IS NULL THEN 1 END) = 0 THEN 'double'
      WHEN count(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')
                 THEN 1 END) = 0 AND count({c}) = count(*) THEN 'boolean'
      ELSE 'string' END AS dtype FROM s""" for c in ["event_id", "user_id", "event_type", "value"]))
def q_csv_infer(spark, sf):
    """Type inference on the string form of a table (as a CSV scan sees it)."""
    from tessera.sources.csv import infer_types, to_missing
    eg = T.events_gaps(spark, sf)
    strings = to_missing(eg.select(*[F.col(c).cast("string").alias(c) for c in eg.columns]))
    types = infer_types(strings)
    return spark.createDataFrame([(c, t) for c, t in types.items()], "column string, dtype string")


@register("csv_round_trip", f"""
WITH {SQL_EG}
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events_gaps""")
def q_csv_round_trip(spark, sf):
    """Write the table as CSV, read it back with the loader's inference."""
    import uuid

    from tessera.session import ensure_checkpoint_dir
    from tessera.sinks import writers
    from tessera.sources.csv import load_csv
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    writers.write_labelled(T.events_gaps(spark, sf), path)
    return r6(load_csv(spark, path))


@register("dbscan_string_key", f"""
WITH RECURSIVE {SQL_UF}, {sql_zscore("user_features", "user_id", UF_COLS, "uz")},
{sql_dbscan("uz", "user_id", UF_COLS, EPS_UF, 5, "ulab")}
SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS user_id, cluster FROM ulab""")
def q_dbscan_string_key(spark, sf):
    from tessera.plans.train import train
    uf = T.user_features(spark, sf).withColumn("user_id", F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
    return train(uf, "user_id", "DBSCAN", {"eps": EPS_UF, "min_samples": 5}, silhouette="none").labels


@register("dbscan_composite_key", f"""
WITH RECURSIVE {SQL_UF}, {sql_zscore("user_features", "user_id", UF_COLS, "uz")},
{sql_dbscan("uz", "user_id", UF_COLS, EPS_UF, 5, "ulab")}
SELECT CAST(user_id // 10 AS BIGINT) AS a, CAST(user_id % 10 AS BIGINT) AS b, cluster FROM ulab""")
def q_dbscan_composite_key(spark, sf):
    from tessera.plans.train import train
    uf = (T.user_features(spark, sf).withColumn("a", F.floor(F.col("user_id") / 10)).withColumn("b", F.col("user_id") % 10)
          .drop("user_id"))
    return train(uf, ["a", "b"], "DBSCAN", {"eps": EPS_UF, "min_samples": 5}, silhouette="none").labels


@register("kmeans_check", f"""
WITH {SQL_CF}
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS off_centre, true AS cost_agrees
FROM customer_features""")
def q_kmeans_check(spark, sf):
    """What a fit must satisfy: every row in its nearest cluster's mean, every
    centre the mean of its rows (to the convergence tolerance), cost = sum d2."""
    cf = T.customer_features(spark, sf)
    enc = encode.preprocess(cf, ["c_custkey"], "StandardScaler", "Mean")
    fit = kmeans.kmeans_fit(enc.frame, "c_custkey", 3)
    dist = [F.sqrt(sum((F.col("x")[i] - F.lit(v)) * (F.col("x")[i] - F.lit(v)) for i, v in enumerate(c))) for c in fit.centres]
    lab = kmeans.assign(enc.frame, fit.centres).withColumn("ds", F.array(*dist))
    near = lab.agg(F.count(F.lit(1)).alias("rows"),
                   F.count(F.when(F.col("ds")[F.col("cluster")] > F.array_min("ds") + 1e-9, 1)).alias("not_nearest"),
                   F.sum(F.pow(F.array_min("ds"), F.lit(2))).alias("cost"))
    means = lab.groupBy("cluster").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(enc.dim)]).alias("m"))
    centres = F.array(*[F.array(*[F.lit(v) for v in c]) for c in fit.centres])
    gap = F.array_max(F.zip_with("m", centres[F.col("cluster")], lambda u, v: F.abs(u - v)))
    off = means.where(gap > 0.05).count()
    return near.select("rows", "not_nearest", F.lit(off).cast("bigint").alias("off_centre"),
                       (F.abs(F.col("cost") / F.lit(fit.inertia) - 1) < 1e-6).alias("cost_agrees"))


@register("report")
def q_report(spark, sf):
    """The eight-section report for DBSCAN on the per-user features."""
    from tessera.plans.report import build_report
    from tessera.plans.train import train
    uf = T.user_features(spark, sf)
    res = train(uf, "user_id", "DBSCAN", {"eps": EPS_UF, "min_samples": 5})
    labelled = results.label_join(uf, res.labels, ["user_id"])
    return build_report(spark, labelled, ["user_id"], res.metrics, "DBSCAN", "Mean", "StandardScaler", "None")


@register("stream_cluster_drift")
def q_stream_cluster_drift(spark, sf):
    """Events replayed as a stream, scored by a static KMeans, counted per day."""
    from tessera.streaming.assign import events_drift
    return events_drift(spark, sf)


FIXED_CENTRES = (10.0, 40.0, 90.0)


@register("stream_fixed_centres", f"""
WITH s AS (SELECT date_trunc('day', ts) AS d, CASE {" ".join(
    f"WHEN {' AND '.join(f'abs(value - {c}) <= abs(value - {o})' for o in FIXED_CENTRES)} THEN {i}" for i, c in enumerate(FIXED_CENTRES))} END AS cluster
  FROM events)
SELECT CAST(d AS TIMESTAMP) AS window_start, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, CAST(cluster AS INTEGER) AS cluster,
       CAST(count(*) AS BIGINT) AS n FROM s GROUP BY d, cluster""")
def q_stream_fixed_centres(spark, sf):
    """The stream with a given model: nearest of three values, per day."""
    from tessera.streaming.assign import events_drift
    meta = {"algorithm": "KMeans", "params": {}, "feature_names": ["value"], "numeric": ["value"], "categories": {}, "imputer": None,
            "scaler": {"kind": "StandardScaler", "center": {"value": 0.0}, "scale": {"value": 1.0}}}
    return events_drift(spark, sf, watermark="400 days", model={"meta": meta, "centres": [[c] for c in FIXED_CENTRES]})


@register("xy_pairs", f"""
WITH {SQL_EG}
SELECT event_id, CAST(user_id AS DOUBLE) AS x, round(value, 6) AS y, event_type AS color FROM events_gaps""")
def q_xy_pairs(spark, sf):
    return r6(profile.xy_pairs(T.events_gaps(spark, sf), ["event_id"], "user_id", "value", "event_type"))


@register("cluster_map")
def q_cluster_map(spark, sf):
    """Cluster map points: 2-D projection of the scaled customer features with
    the DBSCAN labels and the customer name as hover text."""
    enc = encode.preprocess(T.customer_features(spark, sf), ["c_custkey"], "StandardScaler", "Mean")
    labels = dbscan(enc.frame, "c_custkey", EPS_CF_001, 5)
    hover = T.table(spark, sf, "customer").select("c_custkey", "c_name")
    return r6(results.cluster_map(enc.frame, labels, ["c_custkey"], enc.dim, hover))


@register("automl_comparison")
def q_automl_comparison(spark, sf):
    """The comparison series of the ranked search (shown when >= 3 results)."""
    from tessera.plans.search import rank, evaluate, config_grid
    return results.comparison_series(rank(evaluate(_uf_x(spark, sf), "user_id", config_grid(8))))
