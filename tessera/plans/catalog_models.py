"""Queries of the further clustering algorithms and of the measures that help
to choose and judge a clustering. Registered like those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode, kmeans, neighbours, profile, results
from tessera.operators.dbscan import dbscan
from tessera.plans.catalog import (
    EPS_UF,
    SQL_UF,
    SQL_UF_LAB,
    UF_COLS,
    _cf_x,
    _uf_labelled,
    _uf_x,
    r6,
    register,
    sql_dbscan,
    sql_zscore,
)
from tessera.sources import tables as T

# ================================================================ birch

SQL_WHOLE = "whole AS (SELECT l_quantity AS a, floor(l_extendedprice) AS b, round(l_discount * 100) AS c FROM lineitem)"


@register("birch_totals", f"""
WITH {SQL_WHOLE}
SELECT CAST(count(*) AS BIGINT) AS n, sum(a) AS s0, sum(b) AS s1, sum(c) AS s2, sum(a * a + b * b + c * c) AS ss, true AS bounded FROM whole""")
def q_birch_totals(spark, sf):
    """Totals of all micro-clusters; whole numbers, so that sums are exact."""
    from tessera.operators.birch import MAX_CLUSTERS, micro_clusters
    line = T.table(spark, sf, "lineitem")
    x = F.array(F.col("l_quantity").cast("double"), F.floor("l_extendedprice").cast("double"), F.round(F.col("l_discount") * 100).cast("double"))
    micro = micro_clusters(line.select(x.alias("x")), threshold=500.0)
    return micro.agg(F.sum("n").alias("n"), *[F.sum(F.col("ls")[i]).alias(f"s{i}") for i in range(3)], F.sum("ss").alias("ss"),
                     (F.count(F.lit(1)) <= MAX_CLUSTERS).alias("bounded"))


@register("birch")
def q_birch(spark, sf):
    from tessera.operators.birch import birch
    return birch(_cf_x(spark, sf), "c_custkey", 3, threshold=0.3)


# ================================================================ neighbours

K_DISTANCE = 5

SQL_KD = f"""p AS (SELECT event_id, value AS a, CAST(hour(ts) AS DOUBLE) AS b FROM events),
kd AS (SELECT p.event_id, round(sqrt(list_last(min((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b), {K_DISTANCE}))), 6) AS k_distance
       FROM p JOIN p q ON p.event_id <> q.event_id GROUP BY p.event_id)"""


def _k_distances(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", F.array("value", F.hour("ts").cast("double")).alias("x"))
    return neighbours.k_distance(ev, "event_id", K_DISTANCE)


@register("k_distance", f"WITH {SQL_KD} SELECT event_id, k_distance FROM kd")
def q_k_distance(spark, sf):
    """Distance of every event (value, hour) to its fifth nearest other."""
    return r6(_k_distances(spark, sf))


@register("k_distance_curve", f"""
WITH {SQL_KD}
SELECT CAST(row_number() OVER (ORDER BY k_distance, event_id) - 1 AS BIGINT) AS position, event_id, k_distance FROM kd""")
def q_k_distance_curve(spark, sf):
    """The sorted curve whose knee is a good eps."""
    return neighbours.k_distance_curve(r6(_k_distances(spark, sf)), "event_id")


# ================================================================ density modes, spectral

@register("mean_shift")
def q_mean_shift(spark, sf):
    from tessera.operators.meanshift import mean_shift
    return mean_shift(_cf_x(spark, sf), "c_custkey", 1.5)


@register("spectral")
def q_spectral(spark, sf):
    from tessera.operators.spectral import spectral
    return spectral(_uf_x(spark, sf), "user_id", 2, neighbours=10, tol=1e-3)


# ================================================================ wide correlation

WIDE = {
    "quantity": "l_quantity", "price": "CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END",
    "discount": "CASE WHEN l_suppkey % 5 <> 0 THEN l_discount END", "tax": "l_tax",
    "part": "CASE WHEN l_linenumber <> 2 THEN CAST(l_partkey AS DOUBLE) END", "supplier": "CAST(l_suppkey AS DOUBLE)",
    "net": "CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice * (1 - l_discount) END", "flat": "CAST(7 AS DOUBLE)",
}


def _wide_sql() -> str:
    pairs = [(a, b) for a in WIDE for b in WIDE]
    one = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("max(CAST(NULL AS DOUBLE))" if "flat" in (a, b) else f'round(corr("{a}", "{b}"), 6)') + " AS r FROM wide"
        for a, b in pairs)
    return "WITH wide AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in WIDE.items()) + f" FROM lineitem)\n{one}"


@register("corr_gramian", _wide_sql())
def q_corr_gramian(spark, sf):
    """Correlations of eight columns with gaps from masked Gramian blocks."""
    return r6(profile.corr_gramian(T.table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in WIDE.items()])))


# ================================================================ judging a clustering

CENTRES = [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [-1.0, 1.0, 1.0]]

SQL_NEAR = ("near AS (SELECT user_id, CASE " + " ".join(
    "WHEN " + " AND ".join("(" + " + ".join(f"(uz.{c} - {a[i]}) * (uz.{c} - {a[i]})" for i, c in enumerate(UF_COLS)) + ") <= ("
                           + " + ".join(f"(uz.{c} - {b[i]}) * (uz.{c} - {b[i]})" for i, c in enumerate(UF_COLS)) + ")" for b in CENTRES)
    + f" THEN {k}" for k, a in enumerate(CENTRES)) + " END AS cluster FROM uz)")


@register("agreement", f"""
WITH RECURSIVE {SQL_UF}, {sql_zscore("user_features", "user_id", UF_COLS, "uz")},
{sql_dbscan("uz", "user_id", UF_COLS, EPS_UF, 5, "ulab")},
{SQL_NEAR},
ct AS (SELECT u.cluster AS a, v.cluster AS b, count(*) AS n FROM ulab u JOIN near v USING (user_id) GROUP BY u.cluster, v.cluster),
ca AS (SELECT a, sum(n) AS n FROM ct GROUP BY a), cb AS (SELECT b, sum(n) AS n FROM ct GROUP BY b),
t AS (SELECT (SELECT sum(n) FROM ct) AS n, (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS p, (SELECT sum(n * (n - 1) / 2.0) FROM ca) AS pa,
             (SELECT sum(n * (n - 1) / 2.0) FROM cb) AS pb),
i AS (SELECT sum(ct.n / t.n * ln(ct.n * t.n / (ca.n * cb.n))) AS mi FROM ct JOIN ca USING (a) JOIN cb USING (b), t),
h AS (SELECT (SELECT -sum(ca.n / t.n * ln(ca.n / t.n)) FROM ca, t) AS ha, (SELECT -sum(cb.n / t.n * ln(cb.n / t.n)) FROM cb, t) AS hb)
SELECT CAST(t.n AS BIGINT) AS n, round((p - pa * pb / (t.n * (t.n - 1) / 2.0)) / ((pa + pb) / 2 - pa * pb / (t.n * (t.n - 1) / 2.0)), 6) AS ari,
       round(mi, 6) AS mutual_information, round(ha, 6) AS entropy_a, round(hb, 6) AS entropy_b, round(mi / ((ha + hb) / 2), 6) AS nmi FROM t, i, h""")
def q_agreement(spark, sf):
    """DBSCAN labels against the nearest of three given centres."""
    from tessera.operators.agreement import agreement
    x = _uf_x(spark, sf)
    return r6(agreement(dbscan(x, "user_id", EPS_UF, 5), kmeans.assign(x, CENTRES), ["user_id"]))


@register("dunn", f"""
WITH RECURSIVE {SQL_UF}, {sql_zscore("user_features", "user_id", UF_COLS, "uz")},
{SQL_NEAR},
d AS (SELECT a.cluster AS ca, b.cluster AS cb, sqrt({" + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in UF_COLS)}) AS d
      FROM uz p JOIN near a USING (user_id) JOIN (uz q JOIN near b USING (user_id)) ON true),
m AS (SELECT min(CASE WHEN ca <> cb THEN d END) AS sep, max(CASE WHEN ca = cb THEN d END) AS dia FROM d)
SELECT round(sep, 6) AS min_separation, round(dia, 6) AS max_diameter, round(sep / dia, 6) AS dunn FROM m""")
def q_dunn(spark, sf):
    from tessera.operators.separation import dunn
    return r6(dunn(kmeans.assign(_uf_x(spark, sf), CENTRES), "user_id"))


@register("anova_f", "WITH RECURSIVE " + SQL_UF_LAB + ",\nk AS (SELECT * FROM labelled WHERE cluster >= 0),\n" + ",\n".join(
    f"g{i} AS (SELECT cluster, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM k GROUP BY cluster),\n"
    f"w{i} AS (SELECT sum(n * m) / sum(n) AS mean, sum(n) AS n, count(*) AS k, sum(n * v) AS inner_ FROM g{i})" for i, c in enumerate(UF_COLS)) + "\n"
          + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(w{i}.k AS BIGINT) AS clusters, CAST(w{i}.n AS BIGINT) AS rows, round((SELECT sum(g.n * (g.m - w{i}.mean) * (g.m - w{i}.mean)) "
    f"FROM g{i} g, w{i}) / (w{i}.k - 1) / (inner_ / (w{i}.n - w{i}.k)), 6) AS f FROM w{i}" for i, c in enumerate(UF_COLS)))
def q_anova_f(spark, sf):
    """Which features tell the DBSCAN clusters of the users apart."""
    from tessera.operators.anova import anova
    return r6(anova(_uf_labelled(spark, sf), ["user_id"])).drop("p")


@register("gap_statistic")
def q_gap_statistic(spark, sf):
    from tessera.plans.model_choice import gap_statistic
    return r6(gap_statistic(_uf_x(spark, sf), "user_id", max_k=4, references=2))


@register("seed_stability")
def q_seed_stability(spark, sf):
    from tessera.plans.model_choice import seed_stability
    return r6(seed_stability(_uf_x(spark, sf), "user_id", [2, 3], seeds=3))


# ================================================================ many features: the cuts act

def _many(spark, sf):
    """Fourteen features a customer, and four groups of customers."""
    cols = T.customer_features(spark, sf)
    extra = [(F.col("acctbal") * i + F.col("avg_total") / (i + 1) + F.col("n_orders") * (13 - i)).alias(f"f{i:02d}") for i in range(12)]
    return cols.select("c_custkey", "acctbal", "avg_total", *extra, (F.col("c_custkey") % 4).cast("int").alias("cluster"))


SQL_MANY = ("customer_features AS (SELECT c.c_custkey, c.c_acctbal AS acctbal, CAST(o.n AS DOUBLE) AS n_orders, o.avg_total FROM customer c "
            "JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS avg_total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey),\n"
            "many AS (SELECT c_custkey, acctbal, avg_total, " + ", ".join(
                f"acctbal * {i} + avg_total / {i + 1} + n_orders * {13 - i} AS f{i:02d}" for i in range(12))
            + ", CAST(c_custkey % 4 AS INTEGER) AS cluster FROM customer_features)")
MANY = ["acctbal", "avg_total", *[f"f{i:02d}" for i in range(12)]]
SQL_MANY_LONG = SQL_MANY + ",\nlong AS (" + " UNION ALL ".join(f"SELECT cluster, {i} AS pos, '{c}' AS feature, {c} AS v FROM many" for i, c in enumerate(MANY)) + ")"


@register("feature_importance_many", f"""
WITH {SQL_MANY_LONG},
prof AS (SELECT cluster, feature, avg(v) AS mean FROM long GROUP BY cluster, feature)
SELECT feature, round(max(mean) - min(mean), 6) AS spread FROM prof GROUP BY feature ORDER BY max(mean) - min(mean) DESC, feature LIMIT 10""")
def q_feature_importance_many(spark, sf):
    """Fourteen features, of which ten are reported."""
    return r6(results.feature_importance(_many(spark, sf), ["c_custkey"]))


@register("pair_scatter_many", f"""
WITH {SQL_MANY_LONG},
prof AS (SELECT cluster, feature, avg(v) AS mean FROM long GROUP BY cluster, feature),
top AS (SELECT feature FROM prof GROUP BY feature ORDER BY max(mean) - min(mean) DESC, feature LIMIT 4),
rows AS ({" UNION ALL ".join(f"SELECT c_custkey, cluster, '{c}' AS feature, {c} AS value FROM many" for c in MANY)})
SELECT c_custkey, cluster, feature, round(value, 6) AS value FROM rows JOIN top USING (feature)""")
def q_pair_scatter_many(spark, sf):
    """The four features with the largest spread, one row a point and feature."""
    wide = results.pair_scatter(_many(spark, sf), ["c_custkey"])
    feats = [c for c in wide.columns if c not in ("c_custkey", "cluster")]
    return r6(wide.unpivot(["c_custkey", "cluster"], feats, "feature", "value"))


def _many_descriptions_sql() -> str:
    above = ", ".join(f"CASE WHEN p.{c} > o.{c} * 1.1 THEN '{c}' END" for c in MANY)
    below = ", ".join(f"CASE WHEN p.{c} < o.{c} * 0.9 THEN '{c}' END" for c in MANY)
    means = ", ".join(f"avg({c}) AS {c}" for c in MANY)
    return f"""
WITH {SQL_MANY},
g AS (SELECT c_custkey, cluster, {", ".join(f"{c} * (1 + cluster * 0.2) AS {c}" for c in MANY)} FROM many),
o AS (SELECT {means} FROM g), p AS (SELECT cluster, count(*) AS cnt, {means} FROM g GROUP BY cluster),
t AS (SELECT p.cluster, p.cnt, list_filter([{above}], lambda x: x IS NOT NULL) AS ab, list_filter([{below}], lambda x: x IS NOT NULL) AS be FROM p, o),
u AS (SELECT cluster, cnt, list_filter([CASE WHEN len(ab) > 0 THEN 'above-average ' || array_to_string(ab[1:3], ', ') END,
        CASE WHEN len(be) > 0 THEN 'below-average ' || array_to_string(be[1:3], ', ') END], lambda x: x IS NOT NULL) AS parts FROM t)
SELECT cluster, CAST(cnt AS BIGINT) AS n, round(cnt * 100.0 / (SELECT count(*) FROM g), 6) AS pct,
       CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') ELSE 'near-average across all features' END AS description FROM u"""


@register("cluster_descriptions_many", _many_descriptions_sql())
def q_cluster_descriptions_many(spark, sf):
    """Groups that differ in all fourteen features: three of them are named."""
    grown = _many(spark, sf).select("c_custkey", "cluster", *[(F.col(c) * (1 + F.col("cluster") * 0.2)).alias(c) for c in MANY])
    return r6(results.cluster_descriptions(grown, ["c_custkey"]))


# ================================================================ lists that follow from the data

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("kept_column_list", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\" FROM customer HAVING count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) < count(*)" for c in CUSTOMER))
def q_kept_column_list(spark, sf):
    """The names that the default selection keeps, from distinct counts."""
    from tessera.plans.clean_job import default_keep
    keep = default_keep(T.table(spark, sf, "customer").select(*CUSTOMER))
    return spark.createDataFrame([(c,) for c in keep], "column string")


TAX = ["l_tax", "l_discount", "price_k", "quantity_k", "product"]


@register("selected_feature_list", f"""
WITH t AS (SELECT l_tax, l_discount, l_extendedprice / 1000 AS price_k, l_quantity / 1000 AS quantity_k, l_tax * l_discount * 100 AS product FROM lineitem),
v AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS v FROM t" for c in TAX)})
SELECT feature FROM v WHERE v >= 0.01 OR (SELECT max(v) FROM v) <= 0.01""")
def q_selected_feature_list(spark, sf):
    """The features that have enough variance, from the variances."""
    t = T.table(spark, sf, "lineitem").selectExpr("l_tax", "l_discount", "l_extendedprice / 1000 AS price_k", "l_quantity / 1000 AS quantity_k",
                                                  "l_tax * l_discount * 100 AS product")
    return spark.createDataFrame([(c,) for c in profile.select_features(t)], "feature string")


SQL_PAIR_MAP = """p AS (SELECT c_custkey, avg_total AS a, n_orders * 1000 AS b FROM customer_features),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM p),
e AS (SELECT *, (va + vb) / 2 + sqrt((va - vb) * (va - vb) / 4 + c * c) AS l1, (va + vb) / 2 - sqrt((va - vb) * (va - vb) / 4 + c * c) AS l2 FROM m),
u AS (SELECT *, sqrt(c * c + (l1 - va) * (l1 - va)) AS n1, sqrt(c * c + (l2 - va) * (l2 - va)) AS n2 FROM e),
w AS (SELECT ma, mb, c / n1 AS x1, (l1 - va) / n1 AS y1, c / n2 AS x2, (l2 - va) / n2 AS y2 FROM u),
s AS (SELECT *, CASE WHEN abs(x1) >= abs(y1) THEN sign(x1) ELSE sign(y1) END AS s1, CASE WHEN abs(x2) >= abs(y2) THEN sign(x2) ELSE sign(y2) END AS s2 FROM w)"""


@register("cluster_map_pair", f"""
WITH {SQL_MANY}, {SQL_PAIR_MAP}
SELECT p.c_custkey, round(s1 * ((a - ma) * x1 + (b - mb) * y1), 6) AS pc1, round(s2 * ((a - ma) * x2 + (b - mb) * y2), 6) AS pc2,
       CAST(p.c_custkey % 4 AS INTEGER) AS cluster, c_name FROM p JOIN customer USING (c_custkey), s""")
def q_cluster_map_pair(spark, sf):
    """The map of two features: projection on their principal axes, labels and names."""
    cf = T.customer_features(spark, sf).withColumn("b", F.col("n_orders") * 1000)
    labels = cf.select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("cluster"))
    hover = T.table(spark, sf, "customer").select("c_custkey", "c_name")
    return r6(results.cluster_map(encode.assemble(cf, ["c_custkey"], ["avg_total", "b"]), labels, ["c_custkey"], 2, hover))
