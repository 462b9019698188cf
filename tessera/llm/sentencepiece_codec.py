"""SentencePiece encoding and decoding by suffix-array matching.

Per batch of texts the words not met before are concatenated into one index
text. Its suffixes, compared up to the longest piece, are sorted (prefix
doubling from as many characters as one integer holds); every piece is binary-searched for its range of suffixes, which
lists all its occurrences; the occurrences are edges from a position to the
position behind the piece. Sorted by position, they are relaxed from left to
right: an edge extends the segmentation of the prefix it starts at if the
piece may follow that prefix's last piece (``bpe.Merges.fits``), and exactly
one edge into each position does, which makes the result the library's BPE
segmentation. Words are independent because no piece holds U+2581 behind
another character; characters of no piece become byte pieces.

Defined cases: null texts give null pieces, empty texts no pieces; texts are
encoded whole. Decoding concatenates pieces and bytes, drops the dummy
prefix and returns the text (the model's normalisation is the identity).
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import Merges
from tessera.llm.common import held, slices, table, trim

META = "▁"  # stands for a blank
MAX_WORDS = 300_000
INDEX_CHARS = 1 << 18
LOCKSTEP = 256  # longer words are relaxed edge by edge
FREE = 1 << 22  # edge label of a character that is in no piece


class Codec:
    def __init__(self, spec: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=spec)
        n = p.get_piece_size()
        self.bytes_id = {}
        ids, score = {}, {}
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                ids[piece], score[i] = i, p.get_score(i)
        if len(self.bytes_id) != 256 or any(META in x.lstrip(META) for x in ids):
            raise ValueError("a model with byte fallback and without pieces across words is needed")
        if p.encode("a  b", out_type=str) != p.encode("a  b ", out_type=str)[: len(p.encode("a  b", out_type=str))] or "".join(
                p.encode(" ab", out_type=str)) != META * 2 + "ab":
            raise ValueError("a model with a dummy prefix that keeps white space is needed")
        rank = {i: r for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))}
        # characters that only occur inside longer pieces are symbols of their own
        letters = {c for x in ids for c in x}
        self.symbol = {c: ids.get(c, n + k) for k, c in enumerate(sorted(letters))}
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                ia = ids.get(a, self.symbol.get(a) if cut == 1 else None)
                ib = ids.get(b, self.symbol.get(b) if len(b) == 1 else None)
                if ia is not None and ib is not None:
                    pairs[ia, ib] = (rank[i], i)
        symbols = {i: tuple(self.symbol[c] for c in x) for x, i in ids.items()}
        symbols |= {s: (s,) for s in self.symbol.values()}
        self.merges = Merges(pairs, symbols)
        matched = {x: i for x, i in ids.items() if self.merges.edges(i) is not None}
        matched |= {c: s for c, s in self.symbol.items() if c not in matched}
        self.pieces = sorted(matched)
        self.piece_id = np.array([matched[x] for x in self.pieces])
        self.piece_len = np.array([len(x) for x in self.pieces])
        self.depth = int(self.piece_len.max())
        self.pieces_end = n  # ids from here on are characters of no piece of their own
        self.raw = [b""] * n
        for x, i in ids.items():
            self.raw[i] = x.replace(META, " ").encode()
        for b, i in self.bytes_id.items():
            self.raw[i] = bytes([b])
        self._forget()
        self._asked, self._answers = np.full(1 << 20, -1), np.zeros(1 << 20, bool)
        # a character that is in no piece ends a word: it is a few byte pieces by itself
        free = "" if "\n" in letters else "\n"
        self.pattern = re.compile(f"{META}*[^{META}{free}]+|{META}+" + (f"|{free}" if free else ""))
        alphabet = {c: k + 2 for k, c in enumerate(sorted(letters))}  # 0 ends a word, 1 is any other character
        self._code = np.ones(0x110000, np.int32)
        self._code[[ord(c) for c in alphabet]] = list(alphabet.values())
        self._bits = (len(alphabet) + 1).bit_length()
        self._packed = 63 // self._bits  # characters in one integer
        # for every piece and every such run of its characters the smallest and the largest integer that begin with it
        runs = -(-self.depth // self._packed)
        low = np.zeros((len(self.pieces), runs * self._packed), np.int64)
        for k, x in enumerate(self.pieces):
            low[k, : len(x)] = [alphabet[c] for c in x]
        high = np.where(np.arange(low.shape[1]) < self.piece_len[:, None], low, (1 << self._bits) - 1)
        self._low, self._high = (self._pack(x.reshape(len(x), runs, self._packed)) for x in (low, high))

    def _forget(self) -> None:
        """No word is known: their numbers, and by number the place of their ids in ``ids``."""
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.place = np.empty(0, np.int32), np.zeros(1, np.int64)

    # -- index ---------------------------------------------------------
    def _pack(self, codes: np.ndarray) -> np.ndarray:
        """Codes along the last axis as one integer each."""
        key = np.zeros(codes.shape[:-1], np.int64)
        for k in range(codes.shape[-1]):
            key = key << self._bits | codes[..., k]
        return key

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters of all words, each word behind by one 0; word starts and lengths; code points."""
        text = "\0".join(words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes = self._code[points]
        codes[starts + lengths] = 0
        return codes, starts, lengths, points

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes sorted by their first ``depth`` characters, by prefix doubling;
        the first characters of every suffix as one integer (0 behind the end)."""
        n, done = len(codes), self._packed
        padded = np.append(codes, np.zeros(done, codes.dtype))
        runs = key = self._pack(np.lib.stride_tricks.sliding_window_view(padded, done)[:n])
        order = np.argsort(key)
        while done < self.depth:
            at = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, at[1:] != at[:-1]))
            key = rank * n
            key[: max(n - done, 0)] += rank[done:]  # the rank of no more characters is 0
            order = np.argsort(key)
            done *= 2
        return order, runs

    def _ranges(self, runs: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of sorted suffixes that begin with it: binary
        search, one run of characters of all pieces at a time."""
        first = runs[order]
        lo, hi = np.searchsorted(first, self._low[:, 0], "left"), np.searchsorted(first, self._high[:, 0], "right")
        for k in range(1, self._low.shape[1]):
            d = k * self._packed
            live = np.flatnonzero((self.piece_len > d) & (lo < hi))
            if not len(live):
                break
            for side, want in enumerate((self._low[live, k], self._high[live, k])):  # first suffix not below, first above
                a, b = lo[live], hi[live]
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    at = np.minimum(order[np.minimum(mid, len(order) - 1)] + d, len(runs) - 1)
                    below = (runs[at] < want) if side == 0 else (runs[at] <= want)
                    a = np.where(open_ & below, mid + 1, a)
                    b = np.where(open_ & ~below, mid, b)
                if side == 0:
                    begin = a
                else:
                    lo[live], hi[live] = begin, a
        return lo, hi

    # -- relax ---------------------------------------------------------
    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one behind the other, and where each word's end."""
        codes, starts, sizes, points = self._codes(words)
        order, runs = self._suffixes(codes)
        lo, hi = self._ranges(runs, order)
        del runs
        count, other = hi - lo, np.flatnonzero(codes == 1)
        # several edges a character: their arrays are the largest ones, so 32 bits where these do
        kind = np.int32 if int(count.sum()) + len(codes) < 1 << 31 else np.int64
        at = np.repeat((lo - np.concatenate([[0], np.cumsum(count)[:-1]])).astype(kind), count)
        at += np.arange(len(at), dtype=kind)
        begin = np.concatenate([order.astype(kind)[at], other.astype(kind)])
        del at, order
        label = np.concatenate([np.repeat(self.piece_id.astype(kind), count), np.full(len(other), FREE, kind)])
        end = np.concatenate([np.repeat(self.piece_len.astype(kind), count), np.ones(len(other), kind)])
        end += begin
        last = np.full(len(codes) + 1, -1, kind)  # label of the last piece of the segmented prefix
        back = np.zeros(len(codes) + 1, kind)
        last[starts] = FREE
        long, first = np.repeat(sizes > LOCKSTEP, sizes + 1), np.repeat(starts.astype(kind), sizes + 1)
        if long.any():
            far = long[begin]
            self._one_by_one(begin[far], label[far], end[far], last, back)
            begin, label, end = begin[~far], label[~far], end[~far]
        step = np.subtract(end, first[begin], dtype=np.int16, casting="unsafe")  # at most LOCKSTEP
        by = np.argsort(step, kind="stable").astype(kind)
        cuts = np.searchsorted(step[by], np.arange(1, int(step.max(initial=0)) + 2))
        self._lockstep(begin, label, end, by, cuts, last, back)
        del begin, label, end, step, by, first, long
        # all words' paths backwards at once; sorted by place they are the ids in order
        at, left, path = starts + sizes, np.arange(len(words)), []
        while len(left):
            path.append(np.stack([back[at], last[at]]))
            at = back[at]
            more = at > starts[left]
            at, left = at[more], left[more]
        place, ids = np.concatenate(path, axis=1)
        by = np.zeros(len(codes), np.int64)
        by[place] = ids + 1
        place = np.flatnonzero(by)
        ids = by[place] - 1
        odd = ids >= self.pieces_end
        if odd.any():
            spelled = [[self.bytes_id[x] for x in chr(points[p]).encode()] if o else [i]
                       for i, p, o in zip(ids.tolist(), place.tolist(), odd.tolist(), strict=True)]
            place = np.repeat(place, [len(x) for x in spelled])
            ids = np.array([i for x in spelled for i in x])
        return ids.astype(np.int32), np.searchsorted(place, starts + sizes)

    def _may_follow(self, before: np.ndarray, label: np.ndarray) -> np.ndarray:
        """``fits`` for arrays, through a direct-mapped table of earlier answers."""
        keys = before.astype(np.int64) << 24 | label
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        answer = self._answers[slot]
        miss = self._asked[slot] != keys
        if miss.any():
            new, inv = np.unique(keys[miss], return_inverse=True)
            found = self.merges.fits_all(new >> 24, new & 0xFFFFFF)
            answer[miss] = found[inv]
            self._asked[slot[miss]], self._answers[slot[miss]] = keys[miss], found[inv]
        return answer

    def _lockstep(self, begin, label, end, by, cuts, last, back) -> None:
        """Relax the edges of all words, those that end at the words' k-th character together:
        ``by`` lists the edges in this order, ``cuts`` where each character's begin."""
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = by[lo:hi]
            b, x, e = begin[now], label[now], end[now]
            before = last[b]
            open_ = before >= 0
            b, x, e, before = b[open_], x[open_], e[open_], before[open_]
            good = (before == FREE) | (x == FREE)
            ask = np.flatnonzero(~good)
            good[ask] = self._may_follow(before[ask], x[ask])
            last[e[good]], back[e[good]] = x[good], b[good]

    def _one_by_one(self, begin, label, end, last, back) -> None:
        """Relax the edges of very long words in the order of their places."""
        by = np.lexsort((end, begin))
        for b, x, e in zip(begin[by].tolist(), label[by].tolist(), end[by].tolist(), strict=True):
            before = last[b]
            if before >= 0 and (before == FREE or x == FREE or self.merges.fits(int(before), x)):
                last[e], back[e] = x, b

    # -- texts ---------------------------------------------------------
    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.number) > MAX_WORDS:
            self._forget()
        # a text is kept as its words' numbers, so that the words of one text are held at a time and the new ones
        known, numbers, get = len(self.number), [], self.number.__getitem__
        try:
            for t in texts:
                words = self.pattern.findall(META + t.replace(" ", META)) if t else []
                numbers.append(None if t is None else np.fromiter(map(get, words), np.int32, len(words)))
            if len(self.number) > known:
                self._learn_all(list(itertools.islice(self.number, known, None)))
                trim()
        except BaseException:
            self._forget()  # words have numbers already, but no ids
            raise
        return [None if x is None else self._spelled(x) for x in numbers]

    def _learn_all(self, new: list[str]) -> None:
        ids, place = [self.ids], [self.place]
        part, size = [], 0
        for k, w in enumerate(new, 1):
            part.append(w)
            size += len(w) + 1
            if size >= INDEX_CHARS or k == len(new):
                found, ends = self._learn(part)
                ids.append(found)
                place.append(ends + place[-1][-1])
                part, size = [], 0
        self.ids, self.place = np.concatenate(ids), np.concatenate(place)

    def _spelled(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, one behind the other."""
        begin = self.place[numbers]
        many = self.place[numbers + 1] - begin
        at = np.repeat(begin - np.cumsum(many) + many, many)
        at += np.arange(len(at))
        return self.ids[at]

    def decode(self, ids) -> str:
        if ids is None:
            return None
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(spec: bytes) -> Codec:
    """One codec a worker process."""
    return held(("codec", hash(spec)), lambda: Codec(spec))


def _spec(spark: SparkSession, model_path: str):
    with open(model_path, "rb") as f:  # a vocabulary of under a MB, sent to every executor once
        return spark.sparkContext.broadcast(f.read())


def _free(df: DataFrame, out: str) -> None:
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out!r} already; name the result otherwise (out=...)")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with the array column ``out`` of piece ids; a null text has null pieces."""
    _free(docs, out)
    spec = _spec(docs.sparkSession, model_path)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(spec.value)
        for whole in batches:
            for b in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.encode(b.column(text_col).to_pylist()), pa.list_(pa.int32()))],
                                                 [*b.schema.names, out])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``out``, the text of the pieces."""
    _free(encoded, out)
    spec = _spec(encoded.sparkSession, model_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        c = codec(spec.value)
        for b in batches:
            texts = [c.decode(x) for x in b.column(pieces_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text (null counts as empty), with n_pieces, the SHA-256 of the ids as
    little-endian 32-bit integers, and whether decoding gives the text back;
    encoding and decoding run in one task, so ids need not be shuffled."""
    spec = _spec(docs.sparkSession, model_path)
    rest = [c for c in docs.columns if c != text_col]
    schema = (docs.select(*rest).withColumn("n_pieces", F.lit(0).cast("long")).withColumn("pieces_sha256", F.lit("").cast("string"))
              .withColumn("round_trip", F.lit(True).cast("boolean"))).schema

    def run(batches):
        c = codec(spec.value)
        for whole in batches:
            for b in slices(whole, text_col):
                texts = [t or "" for t in b.column(text_col).to_pylist()]
                ids = c.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in rest), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                     pa.array([c.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)])],
                    [*rest, "n_pieces", "pieces_sha256", "round_trip"])
    return docs.mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
