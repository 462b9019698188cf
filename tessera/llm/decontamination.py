"""Benchmark decontamination: n-gram seeds and local alignment.

Words are runs of characters other than blanks and ASCII punctuation, in
lower case. Every n-gram of an item is a seed, however many documents hold
it. Around the seeds of an item in a document a window is taken that no
alignment at the threshold through the seed can leave (overlapping windows
merged). A window that has too few of the item's words for the threshold is
passed over; the others are aligned with the item by Smith-Waterman over
words (match 2, mismatch and gap -1). Score is the alignment score over that
of a full match; at ``threshold`` the document is contaminated. So a pair is
found whenever an alignment at the threshold holds ``n`` words in a row.

The benchmark is the query set: it is taken in blocks of about
``BLOCK_CHARS`` characters, each sent to the tasks and held against all
documents. Defined cases: null and empty texts and items without words match
nothing; items shorter than n words are seeded by their whole sequence; equal
items and repeated rows each give their rows; a null id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.common import slices, table, utf8

NGRAM = 3
THRESHOLD = 0.5
BLOCK_CHARS = 8_000_000
#: Seeds (n-gram in a row, item that has it) and window words held at once.
SEEDS = 1_000_000
#: Cells of the windows that are aligned together.
CELLS = 1 << 20

BREAKS = words.SEPARATOR.copy()
BREAKS[33:48] = BREAKS[58:65] = BREAKS[91:97] = BREAKS[123:127] = True


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(texts)
    starts, ends, first = words.word_spans(data, off, BREAKS)
    return words.hash_spans(data, starts, ends), first


def _owned(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """One key for a word as a word of an item."""
    return words.mix(h + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Items:
    """A block of the benchmark: word hashes and n-grams by item."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        h, first = _words(pa.array(texts, pa.string()))
        self.n, self.ids = n, ids
        self.words = [h[first[i]: first[i + 1]] for i in range(len(ids))]
        self.sizes = np.diff(first)
        self.own, self.times = np.unique(_owned(h, np.repeat(np.arange(len(ids)), self.sizes)), return_counts=True)
        grams = []  # (length, gram, item, place)
        for i, w in enumerate(self.words):
            m = min(n, len(w))
            if m:
                g = words.ngrams(w, np.array([0, len(w)]), m)[0]
                grams += [(m, x, i, k) for k, x in enumerate(g.tolist())]
        self.lengths = sorted({g[0] for g in grams})
        self.by_length = {}
        for m in self.lengths:
            own = sorted((g[1], g[2], g[3]) for g in grams if g[0] == m)
            self._index(m, np.array([g[0] for g in own], np.uint64), np.array([g[1] for g in own]), np.array([g[2] for g in own]))

    def _index(self, m, gram, item, place):
        known, start = np.unique(gram, return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[(known >> np.uint64(44)).astype(np.int64)] = True
        self.by_length[m] = (known, np.append(start, len(gram)), item, place, bits)

    def hits(self, h: np.ndarray, first: np.ndarray):
        """For each n-gram length: (row, word place in row, index of the known n-gram)."""
        for m in self.lengths:
            known, _, _, _, bits = self.by_length[m]
            if not len(known):
                continue
            grams, gfirst, _ = words.ngrams(h, first, m)
            maybe = np.flatnonzero(bits[(grams >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
            ok = known[at] == grams[maybe]
            maybe, at = maybe[ok], at[ok]
            row = np.searchsorted(gfirst, maybe, side="right") - 1
            yield m, row, maybe - gfirst[row], at


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of item k with window k (arrays of word hashes)."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(windows[k]), len(items[k])))
    lo = 0
    while lo < len(order):
        width = len(windows[order[lo]])
        hi = lo + 1
        while hi < len(order) and hi - lo < 512 and len(windows[order[hi]]) <= 2 * width + 16 and (hi - lo) * len(windows[order[hi]]) < CELLS:
            hi += 1
        lanes = order[lo:hi]
        width, height = max(len(windows[k]) for k in lanes), max(len(items[k]) for k in lanes)
        win = np.zeros((len(lanes), width), np.uint64)
        item = np.zeros((len(lanes), height), np.uint64)
        inside, real = np.zeros(win.shape, bool), np.zeros(item.shape, bool)
        for r, k in enumerate(lanes):
            win[r, : len(windows[k])], inside[r, : len(windows[k])] = windows[k], True
            item[r, : len(items[k])], real[r, : len(items[k])] = items[k], True
        ramp = np.arange(width + 1, dtype=np.int32)
        above = np.zeros((len(lanes), width + 1), np.int32)
        best = np.zeros(len(lanes), np.int32)
        for i in range(height):
            same = (win == item[:, i: i + 1]) & inside & real[:, i: i + 1]
            here = np.zeros_like(above)
            here[:, 1:] = np.maximum(above[:, :-1] + np.where(same, 2, -1), above[:, 1:] - 1)
            np.maximum(here, 0, out=here)
            # gaps along the window: the best earlier cell less its distance
            here = np.maximum.accumulate(here + ramp, axis=1) - ramp
            above = here
            best = np.maximum(best, here.max(axis=1))
        out[lanes] = best
        lo = hi
    return out


def _common(block: Items, h: np.ndarray, start: np.ndarray, size: np.ndarray, it: np.ndarray) -> np.ndarray:
    """Words that window k (``size`` words from ``start``) and its item have in
    common, repeats counted: no alignment has more matches."""
    out = np.zeros(len(it), np.int64)
    lo, reach = 0, np.cumsum(size)
    while lo < len(it):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + SEEDS, side="right")))
        n = size[lo:hi]
        at = np.arange(n.sum()) + np.repeat(start[lo:hi] - (np.cumsum(n) - n), n)
        window = np.repeat(np.arange(hi - lo), n)
        key = _owned(h[at], it[lo:hi][window])
        known = np.minimum(np.searchsorted(block.own, key), len(block.own) - 1)
        ok = block.own[known] == key
        pair, times = np.unique(window[ok] * len(block.own) + known[ok], return_counts=True)
        out[lo:hi] = np.bincount(pair // len(block.own), np.minimum(times, block.times[pair % len(block.own)]), hi - lo)
        lo = hi
    return out


def _found(block: Items, h: np.ndarray, first: np.ndarray, threshold: float):
    """(row, item, score) of the rows' windows that reach the threshold; best per pair."""
    hits = [(m, row, place, at, block.by_length[m][1]) for m, row, place, at in block.hits(h, first)]
    rows = len(first) - 1
    if rows > 1 and sum((start[at + 1] - start[at]).sum() for _, _, _, at, start in hits) > SEEDS:
        half = rows // 2
        cut = first[half]
        return (_found(block, h[:cut], first[: half + 1], threshold)
                + [(r + half, i, s) for r, i, s in _found(block, h[cut:], first[half:] - cut, threshold)])
    seeds = []
    for m, row, place, at, start in hits:
        _, _, item, where, _ = block.by_length[m]
        times = start[at + 1] - start[at]
        k = np.repeat(start[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        row, place = np.repeat(row, times), np.repeat(place, times)
        size = block.sizes[item[k]]
        # an alignment at the threshold has no more gaps, as each takes one off a full match
        slack = np.maximum(np.floor(2 * size * (1 - threshold) + 1e-9), 0).astype(np.int64)
        seeds.append((row, item[k], np.maximum(place - where[k] - slack, 0), np.minimum(place - where[k] + size + slack, np.diff(first)[row])))
    if not sum(len(x[0]) for x in seeds):
        return []
    row, it, lo, hi = (np.concatenate(x) for x in zip(*seeds, strict=True))
    by = np.lexsort((lo, it, row))
    row, it, lo, hi = row[by], it[by], lo[by], hi[by]
    # merge overlapping windows of one row and item: shifted by pair, none reaches into the next pair
    pair = np.concatenate([[0], np.cumsum((row[1:] != row[:-1]) | (it[1:] != it[:-1]))]) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + pair)
    group = np.flatnonzero(np.concatenate([[True], (lo + pair)[1:] > reach[:-1]]))
    hi = np.maximum.reduceat(hi, group)
    row, it, lo = row[group], it[group], lo[group]
    ok = _common(block, h, first[row] + lo, hi - lo, it) / block.sizes[it] >= threshold
    row, it, lo, hi = row[ok], it[ok], lo[ok], hi[ok]
    best: dict[tuple[int, int], float] = {}
    items = [block.words[i] for i in it.tolist()]
    windows = [h[first[r] + a: first[r] + b] for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    for r, i, s in zip(row.tolist(), it.tolist(), align(items, windows).tolist(), strict=True):
        score = s / (2 * len(block.words[i]))
        if score >= threshold:
            best[r, i] = max(best.get((r, i), 0.0), score)
    return [(r, i, s) for (r, i), s in best.items()]


def _blocks(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, n: int):
    """The benchmark's blocks, broadcast."""
    query = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = query.agg(F.sum(F.char_length("t"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_CHARS))
    for p in range(parts):
        got = query.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()
        yield docs.sparkSession.sparkContext.broadcast(Items([r["i"] for r in got], [r["t"] for r in got], n))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, item_id, score)`` of every document and item it holds."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _blocks(docs, items, item_id, item_text, n):
        def run(batches, shared=shared):
            block = shared.value
            for whole in batches:
                for b in slices(whole, "text"):
                    found = _found(block, *_words(b.column("text")), threshold)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([block.ids[f[1]] for f in found], pa.int64()),
                         pa.array([f[2] for f in found], pa.float64())], [id_col, item_id, "score"])
        part = src.mapInArrow(run, f"{id_col} long, {item_id} long, score double")
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                         n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    for shared in _blocks(docs, items, item_id, item_text, n):
        def run(batches, shared=shared):
            for whole in batches:
                for b in slices(whole, text_col):
                    keep = np.ones(b.num_rows, bool)
                    keep[[f[0] for f in _found(shared.value, *_words(b.column(text_col)), threshold)]] = False
                    yield b.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
