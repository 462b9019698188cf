"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, ship_package

#: Rows a batch on the way to Python workers.
BATCH_ROWS = 1000
#: Ids at most so many (8 bytes each) may be broadcast; beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000


def prepare(spark: SparkSession) -> None:
    """Ship the package, and send texts to Python workers in small batches:
    ten thousand documents at once would be held several times over."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    It cuts the lineage and is the recovery point when an executor is lost;
    unlike an RDD checkpoint, later reads fetch only the columns they use.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def semi_by_id(big: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of ``big`` whose ``col`` is in ``ids`` (distinct). The ids are
    broadcast only when counted to be at most BROADCAST_IDS; otherwise the
    join is shuffled. The result is the same."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return big.join(ids, col, "left_semi")


_HELD: dict = {}


def held(key, build):
    """A large structure that a worker process keeps for its next tasks, built
    when first asked for; one at a time, as workers serve many operators."""
    if key not in _HELD:
        let_go()
        _HELD[key] = build()
    return _HELD[key]


def let_go() -> None:
    """Give the memory of a structure that an earlier operator held back to
    the system; called when the tasks of an operator that holds none begin."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free already back to the system: the allocators of
    several workers beside one JVM would each keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if give_back is not None:
        give_back(0)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = 4 << 20):
    """Cut a batch into row ranges of about ``max_bytes`` of text (at least
    one row each), so that temporary arrays stay small."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = utf8(batch.column(text_col))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield batch.slice(lo, hi - lo)
        lo = hi


def sorted_groups(batches, keys: list[str]):
    """Groups of consecutive rows with equal ``keys`` from key-sorted record
    batches, one pyarrow Table at a time (a group may span batches)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo > 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
