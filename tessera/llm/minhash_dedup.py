"""MinHash near-duplicates by bottom-k sketches of one hash function.

Every document has the set of its 5-word shingles, as 64-bit hashes. The
same hash orders the set: its ``k`` smallest values are the sketch, and the
sketch values are the keys of inverted lists.

1. Documents with equal sets (size and 128-bit fingerprint of the whole set)
   form one class; only class representatives are compared.
2. A pair of Jaccard similarity >= 0.85 shares far more than ``share`` (0.6)
   of its sketches (k = 64: below 60 % has a probability of about 1e-7 at exactly
   0.85). Sketch values are ranked by how many documents retain them, and a
   document enters the lists of its rarest values only: so many that two
   documents sharing ``share`` of their sketches must meet (prefix
   filtering). A passage copied into a third of the corpus makes its
   values frequent, hence last, and they link only documents made of it.
3. Short lists are paired; in long lists, groups of thousands of near
   copies, every document is compared with the list's pivot. Links merge
   documents into components, and lists that still span several components
   are compared in full inside the tasks, as pairs of blocks of ``block``
   documents, by their full sets; of the links found between different
   components a spanning forest leaves the task. Pairs inside one component
   decide nothing and are never formed.
4. Each pair of a short list or with a pivot is filtered by the union sketch:
   of the k smallest values of both sketches, the share in both estimates
   Jaccard; below ``estimate`` (over 4.5 standard errors under 0.85, a chance
   of about 1e-5 for a pair at exactly 0.85) it is dropped.
5. What is left is verified on the full sets.

Defined cases: null, empty or blank texts have no shingles and link with
nothing; texts of 1-4 words have one shingle, the whole sequence; a null id
gets null component and kept = false; rows that share an id are one vertex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.common import let_go, materialize, semi_by_id, slices, sorted_groups, table, utf8
from tessera.operators.graph import component_labels

K = 64
SHORT_LIST = 16
BLOCK = 1024
#: Shingles of all members of a block at most (on average, by a hash of the id).
BLOCK_SHINGLES = 1 << 20
FEATURES = "id long, n_shingles long, f1 long, f2 long, sketch array<long>"


def _shingle_sets(batch: pa.RecordBatch, n: int):
    """Per row of the batch: sorted distinct shingle hashes (uint64)."""
    data, off = utf8(batch.column("text"))
    starts, ends, first = words.word_spans(data, off)
    h = words.hash_spans(data, starts, ends)
    grams, gfirst, _ = words.ngrams(h, first, n)
    for i in range(batch.num_rows):
        lo, hi = gfirst[i], gfirst[i + 1]
        if hi > lo:
            g = np.sort(grams[lo:hi])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            yield g[keep]
        elif first[i + 1] > first[i]:
            yield np.array([words.short_sequence_hash(h[first[i]:first[i + 1]])], np.uint64)
        else:
            yield grams[:0]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64()))


def _features(n: int, k: int):
    def run(batches):
        let_go()
        for whole in batches:
            for b in slices(whole, "text"):
                size, f1, f2, sketch = [], [], [], []
                for s in _shingle_sets(b, n):
                    size.append(len(s))
                    again = words.mix(s + np.uint64(0x632BE59BD9B4E019))
                    f1.append(np.add.reduce(again))
                    f2.append(np.bitwise_xor.reduce(words.mix(again + np.uint64(0x9E6C63D0876A9A47))))
                    sketch.append(words.signed(s[:k]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(size, pa.int64()),
                     pa.array(np.array(f1, np.uint64).view(np.int64)),
                     pa.array(np.array(f2, np.uint64).view(np.int64)), _lists(sketch)],
                    ["id", "n_shingles", "f1", "f2", "sketch"])
    return run


def _full_sets(n: int):
    def run(batches):
        let_go()
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [words.signed(s) for s in _shingle_sets(b, n)]
                yield pa.RecordBatch.from_arrays([b.column("id"), _lists(sets)], ["id", "shingles"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, k: int, estimate: float, percent: int) -> DataFrame:
    """Links (src, dst) among candidate pairs (a, b): filtered by the union
    sketch, then verified on the full sets."""
    sketch = F.slice("shingles", 1, k)  # the sets are sorted by the hash
    sa = sets.select(F.col("id").alias("a"), sketch.alias("sa"))
    sb = sets.select(F.col("id").alias("b"), sketch.alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "union"))
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    near = (ordered.join(sa, "a").join(sb, "b").withColumn("union", union)
            .where(both >= F.lit(estimate) * F.size("union")).select("a", "b"))
    xa = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    xb = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    return (near.join(xb, "b").join(xa, "a").withColumn("common", common)
            .where(F.lit(100) * F.col("common")
                   >= F.lit(percent) * (F.size("xa") + F.size("xb") - F.col("common")))
            .select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _rest(long: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (src, dst) between different components in the long lists. The
    members of a list that spans several components are dealt into blocks,
    bounded in members and in shingles; a task compares two blocks by their
    full sets and returns a forest that connects all that their links
    connect, so at most one link a member and pair of blocks leaves it."""
    sized = sets.groupBy("id").agg(F.sum(F.size("shingles")).alias("s"))
    placed = materialize(long.join(sized, "id").join(labels, F.col("id") == F.col("v"), "left")
                         .select("value", "id", "s", F.coalesce("root", "id").alias("root")), "placed")
    open_lists = (placed.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
                  .where("lo <> hi").select("value", F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("s") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")))
    members = (placed.drop("s").join(open_lists, "value").join(sets, "id")
               .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "root", "shingles"))
    return (members.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
            .mapInArrow(_compare_blocks(percent), "src long, dst long"))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of edges (a, b) that connect all that the edges connect, at
    most a few per vertex: every component takes one edge to another, then
    components merge, until no edge crosses."""
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a):]
    label = np.arange(code.max(initial=-1) + 1)
    chosen = []
    open_ = np.flatnonzero(label[x] != label[y])
    while len(open_):
        lx, ly = label[x[open_]], label[y[open_]]
        _, first = np.unique(np.concatenate([lx, ly]), return_index=True)
        pick = np.unique(open_[first % len(open_)])
        chosen.append(pick)
        while True:
            low = np.minimum(label[x[pick]], label[y[pick]])
            before = label.copy()
            np.minimum.at(label, label[x[pick]], low)
            np.minimum.at(label, label[y[pick]], low)
            label = label[label]
            if np.array_equal(before, label):
                break
        open_ = open_[label[x[open_]] != label[y[open_]]]
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def _compare_blocks(percent: int):
    def run(batches):
        for g in sorted_groups(batches, ["value", "i", "j"]):
            ids, roots, side = (g.column(c).to_numpy() for c in ("id", "root", "mine"))
            if roots.min() == roots.max():
                continue
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            col = g.column("shingles").combine_chunks()
            off = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.to_numpy()[off[0]: off[-1]]
            size = np.diff(off)
            _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
            shared = times[code] > 1  # values of one member only are in no intersection
            row = np.repeat(np.arange(len(ids)), size)[shared]
            _, code = np.unique(code[shared], return_inverse=True)
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            x, y = np.flatnonzero(side == i), np.flatnonzero(side == j)
            common = np.zeros((len(x), len(y)), np.float32)  # counts: exact up to 2^24, sets are far smaller
            cuts = np.searchsorted(code, np.arange(0, int(code.max(initial=-1)) + 2049, 2048))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    m = np.zeros((len(ids), 2048), np.float32)
                    m[row[lo:hi], code[lo:hi] % 2048] = 1
                    common += m[x] @ m[y].T
            common = common.astype(np.int64)
            union = size[x][:, None] + size[y][None, :] - common
            a, b = np.nonzero((100 * common >= percent * union) & (common > 0) & (roots[x][:, None] != roots[y][None, :]))
            a, b = x[a], y[b]
            keep = _forest(roots[a], roots[b])
            if len(keep):
                src, dst = ids[a[keep]], ids[b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], ["src", "dst"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    k: int = K, percent: int = 85, share: float | None = None, estimate: float | None = None,
                    short_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two documents are linked when 100 * intersection >= percent * union of
    their shingle sets; ``component_id`` is the smallest id reachable.
    """
    if share is None:
        share = percent / 100 - 0.25
    if estimate is None:
        estimate = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = materialize(src.mapInArrow(_features(shingle, k), FEATURES), "sketches")

    # classes of equal sets; the smallest id represents its class
    classes = materialize(
        feats.where("n_shingles > 0 and id is not null").groupBy("n_shingles", "f1", "f2")
        .agg(F.min("id").alias("rep"), F.max("id").alias("other"), F.first("sketch").alias("sketch")), "classes")
    # inverted lists: a document enters those of its rarest retained values. An id that stands for several
    # sets sorts their values together and takes more of them, never fewer.
    posts = classes.select(F.col("rep").alias("id"), F.explode("sketch").alias("value"), F.size("sketch").alias("s"))
    freq = posts.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    tau = F.ceil(F.lit(share) * F.col("s"))
    shared = (posts.join(freq, "value").groupBy("id", "s")
              .agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("vs")))
    take = F.greatest(F.lit(0), (F.size("vs") - tau + 1).cast("int"))
    entries = materialize(shared.select("id", F.explode(F.array_distinct(F.slice("vs", F.lit(1), take))).alias("e"))
                          .select("id", F.col("e.value").alias("value")), "entries")
    sizes = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("id")).alias("pivot")).where("n > 1")
    lists = materialize(entries.join(sizes, "value"), "lists")

    ids = materialize(lists.select("id").distinct(), "candidates")
    sets = materialize(semi_by_id(src, ids, "id").mapInArrow(_full_sets(shingle), "id long, shingles array<long>"), "sets")

    # short lists pair up; in long lists everyone meets the pivot
    short = lists.where(F.col("n") <= short_list)
    long = lists.where(F.col("n") > short_list)
    x, y = short.select("value", F.col("id").alias("a")), short.select("value", F.col("id").alias("b"))
    pairs = x.join(y, "value").where("a < b").select("a", "b").union(long.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    links = materialize(_verified(pairs, sets, k, estimate, percent), "links")
    if not long.isEmpty():
        links = links.union(materialize(_rest(long.select("value", "id"), component_labels(links), sets, percent, block), "links"))

    # components of the representatives, then of every document
    links = links.union(_shared_ids(feats, classes))
    roots = materialize(component_labels(links).where("v <> root"), "roots")
    mine = (feats.select("id", "n_shingles", "f1", "f2")
            .join(classes.where("rep < other").select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"], "left")
            .select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
            .join(roots.select(F.col("v").alias("rep"), "root"), "rep", "left")
            .select("id", "n_shingles", F.coalesce("root", "rep").alias("component_id")))
    return mine.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
                       (F.col("id").isNotNull() & (F.col("id") == F.col("component_id"))).alias("kept"))


def _shared_ids(feats: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id: such rows are one vertex."""
    several = materialize(feats.where("n_shingles > 0 and id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
                          .where("c > 1").select("id"), "repeated")
    if several.isEmpty():
        return several.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return (feats.join(several, "id", "left_semi").where("n_shingles > 0")
            .join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"])
            .where("rep <> id").select(F.col("rep").alias("src"), F.col("id").alias("dst")))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
