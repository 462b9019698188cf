"""Row numbers in place of keys of any type."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ref
from tessera.operators.graph import dense_index

_WHOLE = ("bigint", "int", "smallint", "tinyint")


def numbered(df: DataFrame, key: str | list[str]) -> tuple[DataFrame, str, DataFrame | None]:
    """(frame, integer key column, its mapping to the real key or None): an
    integer key as it is, any other or composite key through its rank."""
    keys = [key] if isinstance(key, str) else list(key)
    if len(keys) == 1 and keys[0].isidentifier() and dict(df.dtypes)[keys[0]] in _WHOLE:
        return df, keys[0], None
    whole = df.withColumn("_key", F.struct(*[ref(c) for c in keys]))
    ranks = dense_index(whole, "_key", out="_rid").select(F.col("_rid").cast("long").alias("_rid"), "_key")
    ranks = ranks.persist(StorageLevel.MEMORY_AND_DISK)
    frame = whole.join(ranks, "_key").drop("_key", *[ref(k) for k in keys])
    return frame, "_rid", ranks.select("_rid", "_key.*")
