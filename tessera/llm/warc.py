"""WARC archives: writing records, and reading them by boundary chains.

Writing. Each page becomes one WARC/1.1 record, written by Spark's text
writer with the record separator as its line separator, so archives are
plain splittable files in any store Spark can write. Of records with equal
payloads (at least ``min_bytes`` long) the one with the largest id is a
``response`` that carries the payload; the others are ``revisit`` records
without payload that refer to it.

Reading. Spark's text reader cuts the files at the magic and deals byte
ranges out over tasks. The magic may occur inside payloads, so each piece is
only a candidate: a task parses its header and emits the candidate's place,
its place after Content-Length bytes (the successor) and, for pieces that
are not one whole record, the bytes. Places within a range become places in
the file by adding the lengths of the ranges before it. Inside its range a
task already follows each chain to where it leaves the range; between ranges,
pointer jumping from the start of the file (reached places double their
stride every round) keeps only records that the chain from the first record
reaches, in a logarithmic number of rounds. Candidates that the chain skips
are bytes of a payload and are put back into it.

Defined cases: a null payload is empty; ids must not be null to be referred
to: rows with a null id are responses of their own; rows that repeat id and
payload of a response are responses too; a payload that contains the magic,
record separators or whole records comes back byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.session import ensure_checkpoint_dir

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Rows of a few dozen bytes; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hexadecimal digits (four base32
    digits) at a time."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0) -> None:
    """Write one record per row below ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("id"),
                       F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"),
                       payload.alias("payload"))
    src = src.withColumn("n", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # only groups of several ids need a referred record: rows of the others are not shuffled with their payload
    original = (src.where((F.col("n") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest", "n")
                .agg(F.max("id").alias("first"), F.min("id").alias("low")).where("low <> first"))
    revisit = materialize(
        src.select("id", "digest", "n").join(original, ["digest", "n"]).where("id <> first")
        .select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), F.col("n").alias("rn"), "first").distinct(), "revisits")
    if revisit.count() <= BROADCAST_ROWS:  # else the payloads are shuffled to the revisits; same result
        revisit = F.broadcast(revisit)
    out = src.join(revisit, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")) & (F.col("n") == F.col("rn")), "left")
    again = F.col("first").isNotNull()
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), ident, F.lit(">\r\nWARC-Date: " + _DATE + "\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                     "\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">")))
        .otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.when(again, F.lit(0)).otherwise(F.col("n")).cast("string"), F.lit("\r\n\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("payload")))
    out.select(head.alias("value")).write.option("lineSep", END.decode()).text(path)


_LENGTH = re.compile(rb"(?im)^Content-Length: *(\d+) *\r?$")
CANDIDATE = ("file string, block long, rel long, succ long, out long, whole boolean, head string, payload_bytes long, "
             "payload_digest string, body binary, run_end long")


def _walk(batches):
    """(file, block, place of the magic before it within the range, piece,
    bytes read so far) of the pieces a task reads, in order. What precedes
    the first magic of a file is a piece too, with place -len(MAGIC)."""
    here, read = None, 0
    for b in batches:
        for piece, file, block in zip(b.column("value").to_pylist(), b.column("file").to_pylist(),
                                      b.column("block").to_pylist(), strict=True):
            if here != (file, block):
                here, read = (file, block), 0
            start = read - len(MAGIC)
            read += len(piece) + len(MAGIC)
            yield file, block, start, piece, read


def _parse(piece: bytes):
    """(length of the header with its blank line, Content-Length) or None."""
    cut = piece.find(END)
    found = _LENGTH.search(piece, 0, cut + 2) if cut >= 0 else None
    return None if found is None else (cut + len(END), int(found[1]))


def _candidate_rows(with_payload: bool):
    def flush(file, block, rows, end):
        """Follow every chain to where it leaves the range."""
        at = {r[0]: i for i, r in enumerate(rows)}
        out = [0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            nxt = at.get(rows[i][1])
            out[i] = rows[i][1] if nxt is None or nxt <= i else out[nxt]
        cols, n = list(zip(*rows, strict=True)), len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
             pa.array(out, pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()),
             pa.array(cols[5], pa.string()), pa.array(cols[6], pa.binary()), pa.array([end] * n, pa.int64())],
            [f.split()[0] for f in CANDIDATE.split(", ")])

    def run(batches):
        here, rows, end = None, [], 0
        for file, block, start, piece, read in _walk(batches):
            if here != (file, block):
                if rows:
                    yield flush(*here, rows, end)
                here, rows = (file, block), []
            end = read
            parsed = _parse(piece)
            if parsed is None:
                rows.append((start, -1, False, None, None, None, None))
                continue
            first, size = parsed
            whole = len(piece) >= first + size
            body = piece[first: first + size]
            rows.append((start, start + len(MAGIC) + first + size + len(END), whole, piece[:first].decode("utf-8", "replace"), size,
                         base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None,
                         body if whole and with_payload else None))
        if rows:
            yield flush(*here, rows, end)
    return run


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC.decode()).text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def _raw_rows(batches):
    for file, block, start, piece, _ in _walk(batches):
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([start], pa.int64()),
                                          pa.array([piece], pa.binary())], ["file", "block", "rel", "piece"])


def _bases(cand: DataFrame) -> DataFrame:
    """The place of each range's first byte: the lengths of the ranges before it."""
    ranges = cand.groupBy("file", "block").agg(F.max("run_end").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))


def _entries(at: DataFrame) -> DataFrame:
    """(file, at) where the chain from the start of a file enters its ranges,
    by pointer jumping over ``out``, the exits of the ranges."""
    jumps = at.where("out > at").select("file", "at", F.col("out").alias("to"))
    reached = materialize(at.where("at = 0").select("file", "at"), "reached")
    stops = jumps.select("file", F.col("to").alias("at")).union(reached).distinct()
    stride = materialize(jumps.join(stops, ["file", "at"], "left_semi"), "stride")
    places, n = at.select("file", "at"), reached.count()
    while True:
        new = reached.join(stride, ["file", "at"]).select("file", F.col("to").alias("at")).join(places, ["file", "at"], "left_semi")
        reached = materialize(reached.union(new).distinct(), "reached")
        if (m := reached.count()) == n:
            return reached
        n = m
        further = stride.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        stride = materialize(stride.join(further, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "stride")


def _follow(batches):
    """Rows on the chain, from rows sorted by file, range and place that carry
    the place where the chain enters their range."""
    here, nxt = None, None
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i, (file, block, at, succ, entry) in enumerate(zip(*(b.column(c).to_pylist() for c in (
                "file", "block", "at", "succ", "entry")), strict=True)):
            if here != (file, block):
                here, nxt = (file, block), entry
            if at == nxt:
                keep[i], nxt = True, succ
        yield b.filter(pa.array(keep))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record below ``path``: file, at (byte place), record_id,
    record_type, refers, url, header_digest, payload_bytes and payload_digest
    (of the bytes read), and the payload if asked for."""
    cand = materialize(_pieces(spark, path).mapInArrow(_candidate_rows(False), CANDIDATE).drop("body"), "candidates")
    base = materialize(_bases(cand), "ranges")
    at = (cand.join(base, ["file", "block"])
          .select("file", "block", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("succ")).alias("succ"),
                  (F.col("base") + F.col("out")).alias("out"), "whole", "head", "payload_bytes", "payload_digest",
                  (F.col("succ") > F.col("rel")).alias("parsed")))
    at = materialize(at, "places")
    entries = (at.where("parsed").select("file", "block", "at").join(_entries(at.where("parsed")), ["file", "at"], "left_semi")
               .groupBy("file", "block").agg(F.min("at").alias("entry")))
    fields = at.where("parsed").join(entries, ["file", "block"])
    chain = materialize(fields.repartition("file", "block").sortWithinPartitions("file", "block", "at")
                        .mapInArrow(_follow, fields.schema), "chain")
    if with_payload:
        bodies = (_pieces(spark, path).mapInArrow(_candidate_rows(True), CANDIDATE).select("file", "block", "rel", "body")
                  .join(base, ["file", "block"]).select("file", (F.col("base") + F.col("rel")).alias("at"), "body"))
        chain = chain.join(bodies, ["file", "at"])
    else:
        chain = chain.withColumn("body", F.lit(None).cast("binary"))
    if not chain.where("not whole").isEmpty():  # payloads that contain the magic
        joined = _joined(spark, path, base, at, chain.select("file", "at", "whole", "payload_bytes"))
        chain = (chain.join(joined, ["file", "at"], "left")
                 .withColumn("payload_digest", F.when(F.col("whole"), F.col("payload_digest")).otherwise(base32_sha1(F.col("joined"))))
                 .withColumn("body", F.when(F.col("whole"), F.col("body")).otherwise(F.col("joined"))))

    def field(name):
        return F.regexp_extract(F.concat(F.lit("\n"), "head"), rf"(?i)\n{name}: *(.*?) *[\r\n]", 1)

    out = chain.select(
        "file", "at", field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"),
        F.nullif(field("WARC-Refers-To"), F.lit("")).alias("refers"), field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"), "payload_bytes", "payload_digest",
        F.col("body").alias("payload"))
    return out if with_payload else out.drop("payload")


def _joined(spark: SparkSession, path: str, base: DataFrame, at: DataFrame, chain: DataFrame) -> DataFrame:
    """Payloads of records that span several pieces: the pieces from the
    record up to the next record of the chain, put together again."""
    marks = at.select("file", "at").join(chain, ["file", "at"], "left")
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("whole").isNotNull(), F.col("at")), ignorenulls=True).over(w)
    broken = F.last(F.when(F.col("whole").isNotNull(), ~F.col("whole")), ignorenulls=True).over(w)
    need = materialize(marks.select("file", "at", owner.alias("record"), broken.alias("broken")).where("broken").drop("broken"), "spans")
    raw = (_pieces(spark, path).mapInArrow(_raw_rows, "file string, block long, rel long, piece binary")
           .join(base, ["file", "block"]).select("file", (F.col("base") + F.col("rel")).alias("at"), "piece"))
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    whole = (raw.join(need, ["file", "at"]).groupBy("file", "record")
             .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
             .withColumn("bytes", F.aggregate(F.slice("ps", 2, 1 << 30), F.col("ps")[0]["piece"],
                                              lambda acc, p: F.concat(acc, F.lit(MAGIC), p["piece"])))
             .join(chain.where("not whole").select("file", F.col("at").alias("record"), "payload_bytes"), ["file", "record"]))
    # one character a byte, whatever the header holds: the place found is one in bytes
    first = F.instr(F.decode("bytes", "ISO-8859-1"), END.decode())
    return whole.withColumn("first", first).select("file", F.col("record").alias("at"), F.substring(
            "bytes", F.col("first") + 4, F.col("payload_bytes").cast("int")).alias("joined"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared checkpoint folder, read them
    back and describe every page; of a revisit, length and digest are those
    of the response it refers to."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, url_col, payload_col, min_bytes)

    def number(c):
        return F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")

    got = materialize(read_warc(spark, path, with_payload=False)
                      .withColumn("id", number("record_id")).withColumn("refers_to", number("refers")), "records")
    full = (got.where("record_type = 'response'").groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("header_digest"))
            .agg(F.max("payload_bytes").alias("full_bytes"), F.max("payload_digest").alias("full_digest")))
    revisits = (got.where("record_type = 'revisit'").join(full, ["refers_to", "header_digest"], "left")
                .select("id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to"))
    responses = got.where("record_type <> 'revisit'").select(
        "id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.union(revisits).withColumnRenamed("id", id_col)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))

