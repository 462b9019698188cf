"""Conversation trie: against a dictionary of prefixes, DuckDB SQL, and odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import conversation_trie as trie
from tessera.llm import oracles, runs

SCHEMA = "conv_id long, turn long, role string, text string"


def _sha(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(f"{len(role)}:".encode() + role + text).hexdigest()


def conversations_of(rows):
    """{conv_id: [(role, text), ...]} in the documented order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append(((turn is not None, turn or 0, _sha(role, text)), (role or "", text or "")))
    return {c: [t for _, t in sorted(ts)] for c, ts in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids) or 1, saved + sum(sums[k][1] for k in kids))
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])), *sums[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    assert df.columns == COLS
    return sorted((tuple(r) for r in df.collect()), key=str)


def as_they_are(spark, rows):
    """The trie of conversations that are not rebuilt."""
    from pyspark.sql import functions as F
    turns = trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    return trie.prefix_trie(turns.join(convs, "conv_id"), convs)


def query(spark, tmp_path, rows):
    path = tmp_path / "t"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "conversations.parquet"))
    return trie.op11_conversation_trie(spark, str(path))


def test_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    want = brute(rebuilt(conversations_of(rows)))
    assert sorted(con.execute(f"SELECT {', '.join(COLS)} FROM ({oracles.OP11})").fetchall(), key=str) == want
    assert got(trie.op11_conversation_trie(spark, path)) == want


def test_deep_shared_conversations(spark, monkeypatch):
    """Long chains, copies, forks at every place of a block, and hot prefixes that are broadcast."""
    monkeypatch.setattr(runs, "KEY_ROWS", 3)
    rng = random.Random(3)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 4, 5, 8, 9, 31, 90])
        fork = rng.randrange(0, 40)
        for t in range(n):
            rows.append((c * 7 - 100, t, ("user", "assistant")[t % 2], f"turn {t}" if t < fork else f"{rng.randrange(3)} {t}"))
    assert got(as_they_are(spark, rows)) == brute(conversations_of(rows))


def test_hot_conversation_and_copies(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3000)]
    rows += [(c, t, "user", f"t{t % 7}") for c in range(100, 400) for t in range(5)]  # copies of its beginning
    assert got(as_they_are(spark, rows)) == brute(conversations_of(rows))


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(0, None, None, None), (0, None, "user", "a"), (0, 1, "user", None), (0, 1, "user", None), (0, 1, None, "b"),
            (None, 1, "user", "lost"), (1, 1, "user", ""), (2, None, "", ""), (3, 9, "us", "era"), (3, 9, "user", "a"),
            (-7, 1, "user", "x"), (-5, 1, "user", "y"), (-5, 2, "user", "z"), (11, 1, "user", "only")]
    rows += [(20, t, "user", "é" * t) for t in range(12)] + [(24, t, "user", "é" * t) for t in range(12)] + [(22, 0, "u", "long " * 50000)]
    assert got(query(spark, tmp_path, rows)) == brute(rebuilt(conversations_of(rows)))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(1, 1, "user", "x")], [(c, 1, "user", "x") for c in (6, 7, 8)]])
def test_few_rows(spark, tmp_path, rows):
    convs = rebuilt(conversations_of(rows))
    assert got(query(spark, tmp_path, rows)) == (brute(convs) if convs else [])


def test_texts_and_extra_columns(spark):
    from pyspark.sql import functions as F
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 1, "user", "hi")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(3)).withColumn("digest", F.lit("x")).withColumn("n", F.lit(0)).withColumn("_u", F.lit(1))
    turns = trie.numbered_turns(df)
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    nodes = trie.with_texts(trie.prefix_trie(turns.join(convs, "conv_id"), convs), turns, df)
    assert {(r["depth"], r["role"], r["text"], r["n_convs"]) for r in nodes.collect()} == {(0, None, None, 2), (1, "user", "hi", 2), (2, "assistant", "yes", 1)}
