"""Embedding whitening with distributed block matrices.

Vectors become whole numbers, x = floor(scale * c). The model is fitted on
each distinct x once; sums and count are exact. Each task indexes its centred
rows into blocks, the last one filled up with zero rows, which add nothing.
The blocks whose repeated rows are zero as well form the ``BlockMatrix`` of
the fit: its transpose times itself (the long side split over tasks) is the
scatter matrix, whose few columns fit the driver and are decomposed there. A
second product, of the blocks of all rows with the whitening matrix, projects
them; the results come back by block index.

* Rows whose vector is null, empty, or holds a null or non-finite entry are
  left out. Vectors of different lengths are fitted apart, each length as a
  table of its own.
* Repeated rows, ids and null ids each keep a result of their own; only the
  fit takes equal x once.
* Components without variance (eigenvalue not above 1e-12 of the largest)
  cannot be scaled to one and are not returned: a table of one distinct
  vector gives no rows, as an empty one does.
* ``deviation`` is exact; null if it exceeds 64 bits.
* Entries are taken as they are between -2^52 and 2^52 after scaling;
  beyond, they stop there.
* To the driver go a scatter matrix of the vectors' length squared, sums of
  their length, and one row count a task; to one task, a block of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.session import ship_package

SCALE = 256
COMPONENTS = 4
#: Rows a block; as many as keep the number of blocks under BLOCKS, up to BLOCK_VALUES values a block.
BLOCK_ROWS = 1024
BLOCKS = 20_000
BLOCK_VALUES = 1 << 22
#: Blocks that one task multiplies and adds up.
BLOCKS_A_TASK = 8
#: Eigenvalues not above this share of the largest are taken for zero.
NO_VARIANCE = 1e-12
_MOST = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct vectors with sums ``sums``: ``values`` fall,
    ``matrix`` has a column for each component (vector over root of value)."""

    n: int
    sums: list[int]
    values: np.ndarray
    matrix: np.ndarray
    trace: float


def _whole(df: DataFrame, vec_col: str) -> DataFrame:
    """``x``, the scaled vector as longs; rows without a usable vector go."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    scaled = F.transform(v, lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(SCALE)), F.lit(-float(_MOST))),
                                                      F.lit(float(_MOST)))).cast("long"))
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(~bad).withColumn("x", scaled)


def _numbered(blocks: DataFrame) -> DataFrame:
    """``idx`` 0, 1, ... over materialized rows with ``_u`` (task number above
    bit 33, place in the task below): the counts of the tasks are added up."""
    task = F.shiftright("_u", 33)
    counts = blocks.groupBy(task.alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.min("_u").alias("_least"))
    before = Window.partitionBy(F.lit(0)).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_t", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return blocks.join(F.broadcast(ahead), task == F.col("_t")).withColumn("idx", F.col("_ahead") + F.col("_u") - F.col("_least")).drop(
        "_t", "_ahead", "_least")  # one broadcast row a task


def _matrix(blocks: DataFrame, size: int, width: int, fit: bool) -> BlockMatrix:
    """``idx``, ``values`` (a block's columns as bytes), ``reps`` as a matrix
    of row blocks; of the fit, with the rows that are not in it zero."""
    def entry(r):
        values = np.frombuffer(r["values"])
        if fit:
            values = (values.reshape(width, size) * np.array(r["reps"], float)).ravel()
        return (r["idx"], 0), DenseMatrix(size, width, values)

    entries = blocks.select("idx", "values", "reps").rdd.map(entry)  # MLlib takes blocks as an RDD
    whole = BlockMatrix(entries, size, width, size * blocks.count(), width)
    return whole.persist(StorageLevel.MEMORY_AND_DISK)  # each product reads it several times


def _free(m: BlockMatrix) -> None:
    m._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _scatter(whole: BlockMatrix) -> np.ndarray:
    """Transpose times matrix; the rows in between are split over tasks, whose
    products are added up, so no task holds all blocks."""
    splits = max(1, -(-whole.numRowBlocks // BLOCKS_A_TASK))
    product = whole.transpose()._java_matrix_wrapper.call("multiply", whole._java_matrix_wrapper._java_model, splits)
    return np.asarray(BlockMatrix(product, whole.colsPerBlock, whole.colsPerBlock).toLocalMatrix().toArray())


def _column_sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sums of the entries of ``x``; high and low halves apart, so that none overflows."""
    at = rows.select(F.posexplode("x")).groupBy("pos").agg(
        F.sum(F.shiftright("col", 20)).alias("high"), F.sum(F.col("col").bitwiseAND((1 << 20) - 1)).alias("low"))
    found = {r["pos"]: (r["high"] << 20) + r["low"] for r in at.collect()}
    return [found[i] for i in range(width)]


def _into_blocks(n: int, sums: list[int], most: int, size: int):
    """Arrow function: rows (id, rep, x) to blocks of ``size`` rows: their ids,
    ``reps``, ``deviation`` and ``values``, the columns of (n x - S) / n as
    bytes. The difference is exact: in 64 bits where it fits, else in Python's
    whole numbers."""
    width = len(sums)
    narrow = width * (2 * n * max(most, 1)) ** 2 < 1 << 62

    def made(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        flat = t["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        diff = (flat if narrow else flat.astype(object)) * n - np.array(sums, dtype=np.int64 if narrow else object)
        dev = pa.array([int(v) if v < 1 << 63 else None for v in (diff * diff).sum(axis=1)], pa.int64())
        whole = np.zeros((size, width))
        whole[: len(flat)] = (diff / n).astype(np.float64)
        reps = np.zeros(size, bool)
        reps[: len(flat)] = t["rep"].to_numpy(zero_copy_only=False)
        one = pa.array([0, len(flat)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, t["id"].combine_chunks()), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(reps)),
             pa.ListArray.from_arrays(one, dev), pa.array([whole.T.tobytes()], pa.binary())], ["ids", "reps", "deviations", "values"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - rows)
                held.append(part)
                rows, b = rows + part.num_rows, b.slice(part.num_rows)
                if rows == size:
                    yield made(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield made(pa.Table.from_batches(held))

    return run


def _fit(blocks: DataFrame, size: int, n: int, sums: list[int], components: int) -> Whitening:
    whole = _matrix(blocks, size, len(sums), fit=True)
    cov = _scatter(whole) / n
    _free(whole)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")
    top = [i for i in order[:components] if values[i] > NO_VARIANCE * max(values[order[0]], 0) and values[i] > 0]
    return Whitening(n, sums, values[top], vectors[:, top] / np.sqrt(values[top]), float(np.trace(cov)))


def _project(blocks: DataFrame, size: int, model: Whitening) -> DataFrame:
    """``idx``, ``z``: each block's rows times the whitening matrix."""
    spark = blocks.sparkSession
    width, k = model.matrix.shape
    whole = _matrix(blocks, size, width, fit=False)
    entries = spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, k, model.matrix.ravel(order="F")))], 1)
    product = whole.multiply(BlockMatrix(entries, width, k, width, k))
    rows = product.blocks.map(lambda b: (b[0][0], b[1].toArray().tolist()))
    done = materialize(spark.createDataFrame(rows, "idx long, z array<array<double>>", verifySchema=False), "projected")
    _free(whole)
    return done


def whiten(df: DataFrame, id_col: str, vec_col: str, components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Whitening]]:
    """(rows, models): for each usable row ``id``, ``n``, ``deviation``, ``z``
    (its whitened components), ``trace``, ``width`` and ``rep`` (whether it
    stands for its x in the fit); a model for each length of vectors."""
    ship_package(df.sparkSession)
    rows = materialize(_whole(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")), "_v")
                       .select("id", "x", F.monotonically_increasing_id().alias("_u")), "vectors")
    firsts = materialize(rows.groupBy("x").agg(F.min("_u").alias("_u")).select("_u", "x"), "distinct")
    sizes = firsts.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("most"))
    parts, models = [], {}
    id_type = rows.schema["id"].dataType.simpleString()
    for width, n, most in sorted(tuple(r) for r in sizes.collect()):
        mine = F.size("x") == width
        sums = _column_sums(firsts.where(mine), width)
        marked = rows.where(mine).join(firsts.select("_u", F.lit(True).alias("rep")), "_u", "left").select(
            "id", F.coalesce("rep", F.lit(False)).alias("rep"), "x")
        size = max(1, min(max(BLOCK_ROWS, -(-n // BLOCKS)), BLOCK_VALUES // width))
        blocks = materialize(marked.mapInArrow(_into_blocks(n, sums, most, size), f"ids array<{id_type}>, reps array<boolean>, deviations array<long>, values binary")
                             .withColumn("_u", F.monotonically_increasing_id()), "blocks")
        blocks = _numbered(blocks)
        model = models[width] = _fit(blocks, size, n, sums, components)
        if not len(model.values):
            continue
        each = F.explode(F.arrays_zip("ids", "deviations", F.slice("reps", F.lit(1), F.size("ids")).alias("reps"), F.slice("z", F.lit(1), F.size("ids")).alias("z")))
        parts.append(blocks.drop("values").join(_project(blocks, size, model), "idx").select(each.alias("r")).select(
            F.col("r.ids").alias("id"), F.lit(n).cast("long").alias("n"), F.col("r.deviations").alias("deviation"), F.col("r.z").alias("z"),
            F.lit(width).alias("width"), F.col("r.reps").alias("rep")))
    if not parts:
        return df.sparkSession.createDataFrame([], f"id {id_type}, n long, deviation long, z array<double>, width int, rep boolean"), models
    return materialize(reduce(DataFrame.unionByName, parts), "whitened"), models


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By length of vectors, the largest absolute entry of the whitened fit
    rows' covariance (divisor n, centred) minus the identity."""
    out = {}
    for width, model in models.items():
        k = len(model.values)
        if not k:
            continue
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        cov = rows.where("rep").where(F.col("width") == width).agg(
            *[F.covar_pop(F.get("z", F.lit(i)), F.get("z", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
        out[width] = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four whitened components of every row of ``embeddings``."""
    ship_package(spark)
    rows, models = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    errors = identity_errors(rows, models)
    shares = [F.when(F.col("width") == w, F.array(*[F.lit(float(v / m.trace)) for v in m.values])) for w, m in models.items() if len(m.values)]
    error = [F.when(F.col("width") == w, F.lit(float(e))) for w, e in errors.items()]
    none = F.lit(None)
    return (rows.select("id", "n", "deviation", F.posexplode("z").alias("_k", "whitened"),
                        F.coalesce(*shares, none.cast("array<double>")).alias("_shares"),
                        F.coalesce(*error, none.cast("double")).alias("identity_error"))
            .select(F.col("id").alias("vec_id"), (F.col("_k") + 1).alias("component"), "n", "deviation", "whitened",
                    F.get("_shares", F.col("_k")).alias("explained"), "identity_error"))
