"""Near-duplicates against sets of word tuples compared pair by pair."""
import random
import re

from tessera.llm import minhash_dedup
from tessera.llm.minhash_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, percent=85):
    """rows: (id, text); rows that share an id are one vertex."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None, i is not None and find(i) == i) for i, t in rows), key=str)


def check(df, rows, **options):
    got = sorted((tuple(r) for r in near_duplicates(df, **options).collect()), key=str)
    assert got == brute(rows)


def family(rng, n, words=200, edits=25):
    """Copies with 0 to ``edits`` replaced words: similarities on both sides of the threshold."""
    base = [f"w{rng.randrange(9999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


def test_documents(spark, documents, texts):
    check(documents, list(texts.items()))


def test_long_lists_keep_every_link(spark):
    rng = random.Random(3)
    rows = list(enumerate(family(rng, 150) + family(rng, 40, words=900, edits=120) + family(rng, 30, words=12, edits=3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, short_list=4, block=32)  # many blocks
    check(df, rows, short_list=4)
    assert sorted((tuple(r) for r in near_duplicates(df, percent=80).collect()), key=str) == brute(rows, 80)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A B"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"),
            (8, "z " * 3000), (8, "q r s"), (9, "q r s"), (None, "a b"), (None, None), (10, "z z z z z"), (11, "é È é È é")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    clash = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id long, text string, id int, sketch string")
    check(clash, rows)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lists_return_links_in_proportion_to_their_members(spark, monkeypatch):
    """Copies around the threshold: four times the copies, about four times the links."""
    left = []
    rest = minhash_dedup._rest

    def counted(*a):
        out = rest(*a).cache()
        left.append(out.count())
        return out
    monkeypatch.setattr(minhash_dedup, "_rest", counted)
    for n in (200, 800):
        rows = list(enumerate(family(random.Random(9), n, words=120, edits=24)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
        if n == 200:
            assert got == brute(rows)
    assert left[1] <= 8 * left[0] + 800
