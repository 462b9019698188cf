"""Classifier on held-out rows, decontamination, and the pipeline by stage."""
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, quality_classifier, words
from tessera.llm.decontamination import align, contamination

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = quality_classifier.op9_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    n, dims = 80, 12
    rows = [np.flatnonzero(rng.random(dims) < 0.4) for _ in range(n)]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ratio, y, cost = rng.normal(size=dims), np.where(rng.random(n) < 0.4, 1.0, -1.0), np.full(n, 0.7)
    w, bias = quality_classifier.fit_dual(off, np.concatenate(rows), y, ratio, cost, 3000)
    x = np.zeros((n, dims + 1))
    for k, r in enumerate(rows):
        if len(r):
            x[k, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, dims] = 1
    full = np.append(w, bias)
    slack = np.maximum(0, 1 - y * (x @ full))
    gradient = full - 2 * (x * (cost * slack * y)[:, None]).sum(axis=0)
    assert np.abs(gradient).max() < 1e-3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "a b", 2), (None, "x", 2), (4, "ok " * 20000, 2)], "doc_id long, text string, label int")
    none = quality_classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (3, 1), (4, None)], "doc_id long, quality int")
    assert min(r["score"] for r in quality_classifier.score(docs, quality_classifier.train(docs, one)).collect()) > 0.99
    assert quality_classifier.score(docs.limit(0), none).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(0, 6, rng.integers(1, 50)).astype(np.uint64) for _ in range(60)]
    assert align(items, windows).tolist() == [smith_waterman(a, b) for a, b in zip(items, windows, strict=True)]


def test_contamination(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    edited = "one two three 4 five six seven eight nine ten ELEVEN, twelve"
    items = spark.createDataFrame([(1, text), (2, "short item"), (3, None), (4, ""), (5, text), (6, "...")], "item_id long, text string")
    noise = " ".join(f"w{k}" for k in range(300))
    rows = [(1, f"{noise} {text}. {noise}"), (2, f"{noise} {edited} {noise}"), (3, noise), (4, None), (5, ""), (None, f"a short item b {noise}"),
            (6, "one two three " + noise), (1, f"{noise} {text}. {noise}"), (7, (noise + " ") * 50 + text)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    got = sorted(((r[0], r[1]) for r in contamination(df, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, 2, 7) for i in (1, 5)] + [(None, 2)], key=str)
    left = decontamination.without_contaminated(df, items)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "6"]
    assert contamination(df, items.limit(0)).count() == 0 and contamination(df.limit(0), items).count() == 0


def test_copied_items_keep_their_seeds(spark):
    """An item that most documents hold is as frequent as can be, and is found in all of them."""
    item = " ".join(f"p{k}" for k in range(30))
    df = spark.createDataFrame([(k, f"a{k} b{k} {item} c{k}") for k in range(200)], "doc_id long, text string")
    got = contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.count() == 200 and got.agg(F.min("score")).first()[0] == 1.0


def test_edited_copies_are_found_however_many(spark):
    """All pairs against brute force: edited copies and excerpts in 5, 6 and 50
    documents, an inserted word after every third, and a phrase that all hold."""
    own = [[f"i{i}w{k}" for k in range(30)] for i in range(8)]
    items = [(i, " ".join(["which", "of", "the", "following", *w])) for i, w in enumerate(own)]
    rows = []
    for i, copies in ((0, 5), (1, 6), (2, 50)):
        edited = [f"x{k}" if k % 5 == 4 else w for k, w in enumerate(own[i])]
        excerpt = own[i + 3][:17]
        wider = [x for k, w in enumerate(own[6]) for x in ([w, f"y{k}"] if k % 3 == 2 else [w])]
        for c in range(copies):
            for passage in (edited, excerpt, wider, own[7][:10]):
                d = len(rows)
                rows.append((d, " ".join(["which of the following", *(f"d{d}a{k}" for k in range(8)), *passage, *(f"d{d}b{k}" for k in range(8))])))
    want = {}
    for d, text in rows:
        for i, item in items:
            a, b = item.split(), text.split()
            score = smith_waterman(a, b) / (2 * len(a)) if len({*a} & {*b}) * 2 >= len(a) else 0
            if score >= 0.5:
                want[d, i] = score
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) >= 2 * 61 and {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_documents_hold_exact_items(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, wanted = docs.select("doc_id", "text").collect(), items.collect()
    exact = {(d["doc_id"], i["item_id"]) for d in texts for i in wanted if i["text"] in d["text"]}
    got = {(r[0], r[1]): r[2] for r in contamination(docs, items).collect()}
    assert exact <= set(got) and all(s > 0.9 for k, s in got.items() if k in exact)


def test_word_hashes_follow_the_words(texts):
    import pyarrow as pa
    import re
    sample = [*texts.values(), "", None, " \t", "A a é É", "\x0b\x1cx"]
    data, off = __import__("tessera.llm.common", fromlist=["utf8"]).utf8(pa.array(sample))
    starts, ends, first = words.word_spans(data, off)
    h = words.hash_spans(data, starts, ends)
    seen, back = {}, {}
    for k, t in enumerate(sample):
        ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert first[k + 1] - first[k] == len(ws)
        for w, x in zip(ws, h[first[k]: first[k + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_score", F.lit("extra"))
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 6").withColumn("text", F.lit(None).cast("string")))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        kept.append(out.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out
    assert kept == sorted(kept, reverse=True) and kept[-1] > 600
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = spark.read.parquet(f"{SF}/documents.parquet").join(labels.where("quality = 1"), "doc_id").count()
    final = corpus_pipeline.run(spark, SF)
    assert final.select("doc_id").distinct().count() == final.count()
    assert final.join(labels.where("quality = 0"), "doc_id").count() <= 0.05 * good
    assert final.where("n_pieces <> size(pieces)").count() == 0
