"""Agreement of two labellings of the same rows, from their contingency table.

The table has one row for each pair of labels that occur together; all sums
(pairs of rows, entropies) are aggregates over it, so a label that a third of
the rows have costs nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(left: DataFrame, right: DataFrame, keys: list[str], label: str = "cluster") -> DataFrame:
    """``(a, b, n)``: rows with label a in ``left`` and b in ``right`` (rows of both, by key)."""
    a = left.select(*keys, F.col(label).alias("a"))
    b = right.select(*keys, F.col(label).alias("b"))
    return a.join(b, keys).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(left: DataFrame, right: DataFrame, keys: list[str], label: str = "cluster") -> DataFrame:
    """One row: ``n``, ``ari`` (adjusted Rand index), ``mutual_information``,
    ``entropy_a``, ``entropy_b`` (natural logarithms) and ``nmi`` (over the
    mean of the entropies). Both are 1 where both labellings are trivial, null
    without rows. Null is a label of its own."""
    both = contingency(left, right, keys, label)
    sides = [both.groupBy(c).agg(F.sum("n").alias("n")).select(F.lit(t).alias("t"), "n") for c, t in (("a", "a"), ("b", "b"))]
    counts = both.select(F.lit("").alias("t"), "n").unionByName(sides[0]).unionByName(sides[1])
    m = F.col("n").cast("double")
    sums = []
    for t in ("", "a", "b"):
        mine = F.when(F.col("t") == t, m)
        sums += [F.sum(mine * (mine - 1) / 2).alias(f"p{t}"), F.sum(mine * F.ln(mine)).alias(f"x{t}")]
    whole = counts.agg(F.sum(F.when(F.col("t") == "", F.col("n"))).alias("n"), *sums)
    n = F.col("n").cast("double")
    expected = F.coalesce(F.try_divide(F.col("pa") * F.col("pb"), n * (n - 1) / 2), F.lit(0.0))
    best = (F.col("pa") + F.col("pb")) / 2
    one = whole.select(
        F.col("n").cast("long").alias("n"),
        F.when(n.isNotNull(), F.coalesce(F.try_divide(F.col("p") - expected, best - expected), F.lit(1.0))).alias("ari"),
        F.greatest((F.col("x") - F.col("xa") - F.col("xb")) / n + F.ln(n), F.lit(0.0)).alias("mutual_information"),
        F.greatest(F.ln(n) - F.col("xa") / n, F.lit(0.0)).alias("entropy_a"), F.greatest(F.ln(n) - F.col("xb") / n, F.lit(0.0)).alias("entropy_b"))
    mean = (F.col("entropy_a") + F.col("entropy_b")) / 2
    return one.select("*", F.when(F.col("n").isNull(), None).when(mean < 1e-12, 1.0).otherwise(F.col("mutual_information") / mean).alias("nmi"))
