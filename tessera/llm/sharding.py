"""Sharding by sampled splitters (DataFrame functions only).

Records get a sort key (digest of the text, id, record number). A sample in
which a record's chance is in proportion to its size gives quantile
boundaries of the key; they cut the records into many more ranges than there
are shards. Ranges that turn out too full, by bytes or by rows, are cut again
with a denser sample of their own. The exact bytes and rows of the ranges,
summed in key order, then place every record: its shard is where the middle
of its bytes lies when the whole is divided evenly, its slot the number of
records of that shard in front of it. So the sample decides only how the work
is spread; the result is the same for any sample.

* Law: ``bytes``. A shard's bytes differ from total / shards by less than the
  largest record.
* The record number is the last part of the key, so equal texts, equal ids
  and repeated rows can be cut anywhere; equal texts stay next to each other,
  in one shard or in consecutive ones.
* A null text has 0 bytes and the checksum of an empty one. A null id sorts
  first. Repeated rows are records of their own. No rows: no rows. One record
  larger than a shard leaves shards empty.
* To one task or the driver go: boundaries and totals of at most twice
  ``MAX_RANGES`` ranges, and about ``OVERSAMPLE`` sampled keys a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, table

#: Bytes a record counts besides its text.
RECORD_BYTES = 16
#: Records a range holds on average; fewer ranges than MIN_A_SHARD a shard or more than MAX_RANGES are not made.
RANGE_ROWS = 50_000
MIN_A_SHARD = 8
MAX_RANGES = 20_000
#: Sampled keys a range (expected); a range is too full beyond FULL times its share of bytes or FULL_ROWS times that of rows.
OVERSAMPLE = 20
FULL = 2
FULL_ROWS = 8
MAX_ROUNDS = 20

_KEY = ["_h", "_d", "_u"]
_LEAST = -(1 << 63)


def text_bytes(text) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text) -> Column:
    """The first 60 bits of the text's MD5 digest; null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _longs(values: list[int]) -> Column:
    """A constant array; as one string, which the optimizer folds, instead of a literal for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(bounds: list[tuple]) -> Column:
    """Number of ``bounds`` (sorted keys) at or before a record's key, by binary search."""
    if not bounds:
        return F.lit(0)
    parts = [_longs([b[i] for b in bounds]) for i in range(3)]
    key = [F.col(c) for c in _KEY]

    def halve(state, _):
        low, high = state["low"], state["high"]
        mid = F.floor((low + high) / 2).cast("int")
        at = [F.get(p, mid) for p in parts]
        before = (at[0] < key[0]) | ((at[0] == key[0]) & ((at[1] < key[1]) | ((at[1] == key[1]) & (at[2] <= key[2]))))
        return F.when(low >= high, state).otherwise(F.struct(
            F.when(before, mid + 1).otherwise(low).alias("low"), F.when(before, high).otherwise(mid).alias("high")))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def _copies(share: Column, seed: int) -> Column:
    """How often a record is in the sample: its expectation is ``share``, and
    the fraction is settled by a hash of the record number."""
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("_u")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.floor(share + chance).cast("long")


def _quantiles(sample: DataFrame, by: list[str], cuts: Column) -> DataFrame:
    """Keys at which the sample's running weight passes a multiple of its
    ``cuts``-th part. The window is over sampled keys only, whose number is
    bounded (OVERSAMPLE a range)."""
    over = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    upto = over.orderBy(*_KEY)
    total, run = F.sum("_w").over(over), F.sum("_w").over(upto)
    part = F.floor(run * cuts / total)
    return (sample.select("*", part.alias("_p"), F.floor((run - F.col("_w")) * cuts / total).alias("_q"))
            .where("_p > _q").select(*_KEY))


def _keys(df: DataFrame) -> set[tuple]:
    return {tuple(r) for r in df.collect()}


def _splitters(records: DataFrame, shards: int, total: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Records with their range ``_r``, and each range's rows and bytes."""
    n = max(MIN_A_SHARD * shards, min(MAX_RANGES, -(-rows // RANGE_ROWS)))
    spacing = max(1, total // n)
    share = F.col("_size") * (OVERSAMPLE / spacing)
    sample = records.select(*_KEY, _copies(share, 0).alias("_w")).where("_w > 0")
    bounds = sorted(_keys(_quantiles(sample, [], F.lit(n))))
    full = (F.col("_rows") > 1) & ((F.col("_bytes") > FULL * spacing) | (F.col("_rows") * n > FULL_ROWS * rows))
    for seed in range(1, MAX_ROUNDS + 1):
        ranged = records.withColumn("_r", _range_of(bounds))
        sizes = materialize(ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_bytes")), "ranges")
        # a denser sample of each overfull range: as many cuts as its bytes or rows ask for
        cuts = F.expr(f"1 + greatest(_bytes div {spacing}, _rows * {n} div {max(1, 4 * rows)})")
        again = sizes.where(full).select("_r", cuts.alias("_cuts"), (OVERSAMPLE * cuts / F.col("_bytes")).alias("_rate"))
        if seed == MAX_ROUNDS or len(bounds) > 2 * MAX_RANGES or again.isEmpty():
            break
        inside = (ranged.join(F.broadcast(again), "_r")  # at most one row a range
                  .select(*_KEY, "_r", "_cuts", _copies(F.col("_size") * F.col("_rate"), seed).alias("_w")).where("_w > 0"))
        bounds = sorted({*bounds, *_keys(_quantiles(inside, ["_r"], F.col("_cuts")))})
    return ranged, sizes


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` dealt into ``shards`` ranges of nearly equal bytes.

    Returns ``id_col``, ``size``, ``text_crc32``, ``shard`` (0 to shards - 1),
    ``slot`` (0, 1, ... within the shard, in key order) and the columns named
    in ``carry`` (none of which may have one of these names).
    """
    out = [id_col, "size", "text_crc32", "shard", "slot"]
    clash = {c.lower() for c in out} & {c.lower() for c in carry}
    if shards < 1 or clash:
        raise ValueError(f"shards must be at least 1 and carried columns must not be named {sorted(clash) or out}")
    text = F.col(text_col)
    records = materialize(docs.select(
        F.col(id_col).alias("_id"), (text_bytes(text) + RECORD_BYTES).alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"), text_key(text).alias("_h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_d"), F.monotonically_increasing_id().alias("_u"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]), "records")
    whole = records.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).first()
    rows, total = whole["n"], whole["b"] or 0
    ranged, sizes = _splitters(records, shards, total, rows)
    # ranges in key order: rows and bytes in front of each (a bounded number of rows in one window)
    front = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("_r", F.coalesce(F.sum("_rows").over(front), F.lit(0)).alias("_rows0"),
                         F.coalesce(F.sum("_bytes").over(front), F.lit(0)).alias("_bytes0"))
    run = Window.partitionBy("_r").orderBy(*_KEY)
    inner = ranged.select("*", F.row_number().over(run).alias("_i"),
                          F.sum("_size").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    shard = F.expr(f"(2 * (_bytes0 + _s) - _size) * {shards} div {max(1, 2 * total)}").cast("int")
    placed = materialize(inner.join(F.broadcast(ahead), "_r").select(
        "_id", "_size", "_crc", *[f"_c{i}" for i in range(len(carry))],
        shard.alias("_shard"),
        (F.col("_rows0") + F.col("_i") - 1).alias("_row")), "placed")
    first = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_row") - F.col("_first")).alias("slot"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet in one folder a shard (``shard=0``, ...), rows
    with their ``slot``. A shard is written by several tasks, each a run of
    consecutive slots in order."""
    others = tuple(c for c in docs.columns if c != id_col)
    names = {c: free_name(docs.select(id_col), c if c.lower() not in ("size", "text_crc32", "shard", "slot") else f"{c}_") for c in others}
    renamed = docs.select(id_col, *[F.col(c).alias(names[c]) for c in others])
    done = assign(renamed, shards, id_col, names.get(text_col, text_col), tuple(names[c] for c in others))
    (done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


#: Shards of the registered query.
SHARDS = 40


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``."""
    done = assign(table(spark, sf_dir, "documents"), SHARDS)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
