"""Joins onto keys that very many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a shuffled join may bring to one task (or the ten-thousandth part of all rows, if more).
KEY_ROWS = 10_000


def join_shared(many: DataFrame, one: DataFrame, keys: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """Inner join of ``many`` with ``one`` (at most one row a key).

    Keys that more than ``key_rows`` rows of ``many`` have, and more than the
    ten-thousandth part of all rows, are fewer than 10,000: their rows of
    ``one`` are broadcast. The other keys are joined by a shuffle, in which no
    key brings more than that many rows to a task.
    """
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.where(F.col("_n") > key_rows)
    if crowded.isEmpty():
        return many.join(one, keys)
    most = max(key_rows, many.count() // 10_000)
    heavy = F.broadcast(crowded.where(F.col("_n") > most).drop("_n"))
    return many.join(F.broadcast(one.join(heavy, keys)), keys).unionByName(many.join(heavy, keys, "left_anti").join(one, keys))
