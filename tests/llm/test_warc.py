"""Archives: round trip, and magic, separators and records inside payloads."""
import base64
import hashlib
import uuid

import pytest

from tessera.llm import warc
from tessera.session import ensure_checkpoint_dir

M = "WARC/1.1\r\n"
RECORD = M + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
ROWS = [(1, "u", None), (2, "u", ""), (3, "u\r\nX: y", "<p>é</p>"), (4, None, "<p>é</p>"), (5, "a", RECORD + RECORD), (6, "b", "x" + M + "y" + M),
        (7, "c", RECORD + RECORD), (None, "d", "q"), (None, "d", "q"), (8, "d", "q"), (9, "e", "\r\n\r\n"), (9, "e", "\r\n\r\n"),
        (10, "z", M * 700), (11, "z", "A" * 9000 + M + "Content-Length: 99999999\r\n\r\n"), (12, "z", "t" * 4000)]
ROWS += [(100 + i, "k", "row%d" % (i % 7) * 50) for i in range(60)]


def want(rows, least=0):
    largest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            largest[b] = max(largest.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and largest.get(b, i) != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    largest[b] if again else None))
    return sorted(out, key=str)


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_round_trip_over_many_ranges(spark, small_ranges):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, block int").repartition(2)
    for least in (0, 10):
        got = sorted((tuple(r) for r in warc.round_trip(df, min_bytes=least).collect()), key=str)
        assert got == want(ROWS, least)


def test_payloads_come_back(spark, small_ranges):
    path = f"{ensure_checkpoint_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3), path)
    records = warc.read_warc(spark, path).collect()
    assert len(records) == len(ROWS)  # nothing inside a payload is taken for a record
    read = {(r["record_id"], bytes(r["payload"])) for r in records if r["record_type"] == "response"}
    revisited = {w[0] for w in want(ROWS) if w[3] == "revisit"}
    assert read == {(f"<urn:page:{'' if i is None else i}>", (h or "").encode()) for i, _, h in ROWS if i not in revisited}


def test_pages_and_empty_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == want(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_headers_beyond_ascii(spark, small_ranges):
    rows = [(1, "http://x/éü/日本", "x" + M + "y" * 50), (2, "http://x/ß", RECORD * 3), (3, "http://x/é" * 40, "日本" + M + "é" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == want(rows)
