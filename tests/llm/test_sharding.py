"""Sharding: against plain sorting, and with groups, giants and empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

SCHEMA = "doc_id long, text string"


def brute(rows, shards):
    """(doc_id, size, crc, shard, slot) by sorting the records and dividing their bytes."""
    recs = []
    for i, t in rows:
        raw = (t or "").encode()
        recs.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(1 << 63) if i is None else i, len(raw) + 16, zlib.crc32(raw), i))
    recs.sort(key=lambda r: r[:2])
    total, run, slots, out = sum(r[2] for r in recs), 0, {}, []
    for _, _, size, crc, i in recs:
        run += size
        shard = (2 * run - size) * shards // (2 * total)
        out.append((i, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    return sorted(out, key=str)


def spark_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)


@pytest.fixture(scope="module")
def records(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_brute_force(spark, records, shards):
    assert spark_rows(sharding.assign(spark.createDataFrame(records, SCHEMA), shards)) == brute(records, shards)


def test_hot_text_nulls_giants_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = [(i % 3, "same text") for i in range(1500)] + [(5, "same row")] * 800 + [(None, None), (None, ""), (7, None)]
    rows += [(1000 + i, "é" * i) for i in range(300)] + [(9, "long " * 20000)]
    done = sharding.assign(spark.createDataFrame(rows, SCHEMA), 12)
    assert spark_rows(done) == brute(rows, 12)


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """With hardly any first sample, later rounds still bound every range."""
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    rows = [(i, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    records = docs.select((F.length("text") + 16).cast("long").alias("_size"), sharding.text_key(F.col("text")).alias("_h"),
                          F.col("doc_id").alias("_d"), F.col("doc_id").alias("_u"))
    total = sum(len(t) + 16 for _, t in rows)
    _, sizes = sharding._splitters(records, 10, total, len(rows))
    most = sizes.agg(F.max("_bytes"), F.sum("_bytes"), F.count(F.lit(1))).first()
    assert most[1] == total and most[0] <= sharding.FULL * (total // 80) and most[2] >= 40


def test_no_rows_and_one_row(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA), 40).count() == 0
    assert spark_rows(sharding.assign(spark.createDataFrame([(3, None)], SCHEMA), 2)) == [(3, 16, 0, 1, 0)]


def test_written_shards_and_clashing_names(spark, tmp_path):
    rows = [(i, f"words {i} " * (i % 9), i, "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, `_size` string")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["doc_id"], r["shard"], r["slot"], r["shard_"], r["_size"]) for r in back.collect())
    want = sorted((i, s, k, i, "x") for i, _, _, s, k in brute([r[:2] for r in rows], 5))
    assert got == want
    with pytest.raises(ValueError):
        sharding.assign(docs, 5, carry=("shard",))


def test_plan_has_no_python(spark):
    plan = sharding.op12_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
