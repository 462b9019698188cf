"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed into ``dims`` slots: words and
word pairs, and 1- to 3-grams of word shapes (case, length class, leading
and trailing marks, digits, repeats of the word before). Every indicator is
scaled by its class log-count ratio, counted over all labelled training rows
of the corpus; a linear model with squared hinge loss and L2 penalty is then
fitted by dual coordinate descent, and its margin is mapped to [0, 1] by a
logistic curve fitted on the margins of rows the model was not fitted on.

The counts cover all training rows. The model is fitted on a documented
bounded sample of them: ``sample_rows`` labelled rows (those with the
smallest hash of their id and text), each weighted by the inverse frequency
of its class. Scoring reads only the text.

Defined cases: null and empty texts have no features and get the score of
the bias; rows without or with a null label are not learned from; a document
labelled several times counts each time; without training rows, or with one
class only, every score is 0.5 or that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.common import let_go, slices, table, utf8

DIMS = 1 << 18
SAMPLE_ROWS = 6_000
ROUNDS = 8

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small code per word."""
    def count(kind):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
        return total[ends] - total[starts]

    n = ends - starts
    upper, lower, digit, mark = (count(k) for k in (_UPPER, _LOWER, _DIGIT, _MARK))
    letters = n - digit - mark
    case = np.select([letters == 0, (upper > 1) & (lower == 0), (upper > 0) & _UPPER[data[starts]], upper > 0], [0, 1, 2, 3], 4)
    size = np.select([n <= 3, n <= 8, n <= 16, n <= 40], [0, 1, 2, 3], 4)
    tail = np.where(_MARK[data[ends - 1]], data[ends - 1], 0).astype(np.int64)
    marks = np.minimum(mark, 3)
    repeat = np.zeros(len(n), np.int64)
    if len(n) > 1:
        repeat[1:] = hashes[1:] == hashes[:-1]
        repeat[first[:-1][first[:-1] < len(n)]] = 0
    return ((((case * 5 + size) * 4 + marks) * 2 + (digit > 0)) * 128 + tail) * 2 + repeat


def features(texts: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, slots): the distinct slots of every row."""
    data, off = utf8(texts)
    starts, ends, first = words.word_spans(data, off)
    h = words.hash_spans(data, starts, ends)
    shape = words.mix(_shapes(data, starts, ends, h, first).astype(np.uint64) + np.uint64(0xABCD00000000)) if len(h) else h
    streams = [(words.mix(h + np.uint64(1)), first)]
    streams.append(words.ngrams(h, first, 2)[:2])
    streams.append((words.mix(shape + np.uint64(3)), first))
    streams += [words.ngrams(shape, first, n)[:2] for n in (2, 3)]
    out, lengths = [], []
    for i in range(len(texts)):
        # a slot stands for an indicator, so each counts once a row
        got = np.unique(np.concatenate([g[at[i]: at[i + 1]] for g, at in streams]) & np.uint64(dims - 1))
        out.append(got.astype(np.int32))
        lengths.append(len(got))
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), np.concatenate(out) if out else np.empty(0, np.int32)


def _counts(dims: int):
    """Per task one row for each slot met: rows of class 0 and 1 that have it."""
    def run(batches):
        let_go()
        total = np.zeros((2, dims + 1), np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                off, slots = features(b.column("text"), dims)
                y = b.column("label").to_numpy()
                owner = np.repeat(y, np.diff(off))
                for c in (0, 1):
                    total[c, :dims] += np.bincount(slots[owner == c], minlength=dims)
                    total[c, dims] += int((y == c).sum())
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["slot", "n0", "n1"])
    return run


def fit_dual(off: np.ndarray, slots: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int,
             seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge linear model by dual coordinate
    descent; y is -1 or 1, ``cost`` per row, features ratio[slots] scaled to
    unit length plus a constant 1."""
    n = len(y)
    w, bias = np.zeros(len(ratio)), 0.0
    values = ratio[slots]
    norm = np.sqrt(np.maximum(np.add.reduceat(np.append(values * values, 0.0), off[:-1]), 1e-12)) if n else np.empty(0)
    norm[np.diff(off) == 0] = 1.0
    alpha = np.zeros(n)
    own = np.where(np.diff(off) > 0, 2.0, 1.0) + 1 / (2 * cost)  # unit row, constant, squared hinge
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(n):
            at = slots[off[i]: off[i + 1]]
            x = values[off[i]: off[i + 1]] / norm[i]
            g = y[i] * (w[at] @ x + bias) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - g / own[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def margins(off: np.ndarray, slots: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    r = ratio[slots]
    def total(v):
        s = np.concatenate([[0.0], np.cumsum(v)])
        return s[off[1:]] - s[off[:-1]]
    return total(r * w[slots]) / np.sqrt(np.maximum(total(r * r), 1e-12)) + bias


def fit_curve(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic curve (slope, shift) by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (d * m).sum(), d.sum()
        haa, hab, hbb = (s * m * m).sum() + 1e-6, (s * m).sum(), s.sum() + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        a -= (hbb * ga - hab * gb) / det
        b -= (haa * gb - hab * ga) / det
    return max(a, 1e-3), b


def _fit(ratio: np.ndarray, rounds: int, penalty: float):
    """One bounded task: four fifths of the sample fit the weights, the rest the curve."""
    def run(batches):
        slots, y = [], []
        for b in batches:
            slots += [np.asarray(s, np.int64) for s in b.column("slots").to_numpy(zero_copy_only=False)]
            y += b.column("label").to_pylist()
        y = np.where(np.array(y) == 1, 1.0, -1.0)
        part = np.arange(len(y)) % 5 == 4
        model = np.zeros(len(ratio) + 3)
        if len(y) and (y > 0).any() and (y < 0).any():
            def rows(keep):
                picked = [slots[i] for i in np.flatnonzero(keep)]
                off = np.concatenate([[0], np.cumsum([len(p) for p in picked])]).astype(np.int64)
                return off, np.concatenate(picked) if picked else np.empty(0, np.int64), y[keep]

            off, flat, yf = rows(~part)
            share = np.clip((yf > 0).mean(), 1 / len(yf), 1 - 1 / len(yf))
            w, bias = fit_dual(off, flat, yf, ratio, penalty * np.where(yf > 0, 0.5 / share, 0.5 / (1 - share)), rounds)
            off, flat, yc = rows(part)
            if not ((yc > 0).any() and (yc < 0).any()):
                off, flat, yc = rows(part | ~part)
            slope, shift = fit_curve(margins(off, flat, ratio, w, bias), yc)
            model = np.concatenate([w, [bias, slope, shift]])
        elif len(y):
            model[-1] = 20.0 if y[0] > 0 else -20.0
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          dims: int = DIMS, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, penalty: float = 1.0) -> dict[str, np.ndarray]:
    """Ratios, weights, bias and curve learned from ``labels`` (id, label)."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    if known.count() <= 2_000_000:  # 12 bytes each; more are joined by a shuffle, with the same result
        known = F.broadcast(known)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id")
    counted = (src.select("text", "label").mapInArrow(_counts(dims), "slot long, n0 long, n1 long")
               .groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas())  # at most dims + 1 rows
    n = np.zeros((2, dims + 1))
    n[0, counted["slot"]], n[1, counted["slot"]] = counted["n0"], counted["n1"]
    ratio = np.log((n[1, :dims] + 1) / (n[1, dims] + 2)) - np.log((n[0, :dims] + 1) / (n[0, dims] + 2))
    rows = n[:, dims].sum()

    def slots(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                off, flat = features(b.column("text"), dims)
                yield pa.RecordBatch.from_arrays(
                    [b.column("label"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))], ["label", "slots"])

    place = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000))
    picked = (src.where(place < F.lit(max(1, min(1_000_000, round(1e6 * sample_rows / max(rows, 1))))))
              .select("text", "label").mapInArrow(slots, "label int, slots array<int>").limit(2 * sample_rows))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)
    model = picked.repartition(1).mapInArrow(_fit_shared(shared, rounds, penalty), "model binary").first()
    fitted = np.frombuffer(model["model"]) if model is not None else np.zeros(dims + 3)
    return {"ratio": ratio, "weights": fitted[:dims], "rest": fitted[dims:]}


def _fit_shared(ratio, rounds: int, penalty: float):
    def run(batches):
        return _fit(ratio.value, rounds, penalty)(batches)
    return run


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: likelihood of label 1 from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(out, F.lit(0.0)).schema
    text = text_col

    def run(batches):
        let_go()
        m = shared.value
        bias, slope, shift = m["rest"]
        for whole in batches:
            for b in slices(whole, text):
                off, flat = features(b.column(text), len(m["ratio"]))
                z = slope * margins(off, flat, m["ratio"], m["weights"], bias) + shift
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, out])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
