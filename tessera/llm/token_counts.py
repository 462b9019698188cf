"""Token counts by a finite-state transducer compiled from a tokenizer file.

The byte-level BPE vocabulary becomes a deterministic weighted transducer
over bytes. A state is the set of vocabulary prefixes that are open at the
current byte, each with the token before it and the token count at its
start relative to the count now (weighted determinisation); a transition's
weight is the number of tokens it adds (or, where a longer merge undoes
shorter tokens, removes). By the border rule (``bpe.Merges.fits``) exactly
one token can end at each byte, so the sum of the weights over a piece of
text is the length of its BPE encoding. States and transitions are compiled
when first met and dropped when there are ``MAX_STATES`` of them.

Long texts are cut anywhere into chunks that are dealt out over the tasks.
A chunk's map is (head, count, tail): tokens never cross a border from a
non-blank to a blank character, and what follows such a border does not
depend on what precedes it, so the chunk contributes a fixed count between
its first and its last such border, whatever the state it is entered in;
only the fragments outside depend on the neighbours. Maps compose
associatively, ``(h1, n1, t1) (h2, n2, t2) = (h1, n1 + count(t1 h2) + n2, t2)``,
and are combined ARITY at a time in a logarithmic number of rounds.

Special strings inside texts count as the library's default does: one token,
splitting the text. Defined cases: null and empty texts have no tokens; rows
are counted one by one, so repeated ids or rows stay as they are.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import Merges
from tessera.llm.common import held, slices, table

MAX_STATES = 250_000
MAX_WORDS = 400_000
CHUNK_CHARS = 1 << 16
ARITY = 32
#: The characters with the Unicode property White_Space.
BLANK = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Counts of the words met so far, of bounded number."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        n = self.transducer.word(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    def __init__(self, spec: bytes):
        import regex

        model = json.loads(spec)
        kind = model["model"]
        if kind["type"] != "BPE" or (model.get("normalizer") is not None) or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        if any(re.search(f"[{BLANK}]", t["content"]) for t in model["added_tokens"]):
            raise ValueError("added tokens with white space are not supported")
        letters = byte_letters()
        vocab = kind["vocab"]
        added = {t["content"] for t in model["added_tokens"]}
        spell = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in added}
        single = {v[0]: i for i, v in spell.items() if len(v) == 1}
        pairs = {}
        for rank, m in enumerate(kind["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merges = Merges(pairs, {i: tuple(single[x] for x in v) for i, v in spell.items()})
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends = [-1]  # node -> token
        for i, v in spell.items():
            node = 0
            for x in v:
                nxt = self.trie.get(node << 8 | x)
                if nxt is None:
                    nxt = self.trie[node << 8 | x] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.first_special = min((s[0] for s in added), default="")
        self.words = _Words(self)
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states = [start]
        self.index = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # state * 256 + byte -> state, weight

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        open_, last = [], None
        for node, before, count in self.states[state]:
            nxt = self.trie.get(node << 8 | byte)
            if nxt is None:
                continue
            open_.append((nxt, before, count))
            token = self.ends[nxt]
            if last is None and token >= 0 and (
                    self.merges.fits(before, token) if before >= 0 else self.merges.edges(token) is not None):
                last = (token, count + 1)
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        token, now = last
        target = (*((n, b, c - now) for n, b, c in open_), (0, token, 0))
        found = self.index.get(target)
        if found is None:
            found = self.index[target] = len(self.states)
            self.states.append(target)
        self.moves[state << 8 | byte] = (found, now)
        return found, now

    def run(self, piece: bytes) -> int:
        """Tokens of one pre-token: the weights along its path."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for byte in piece:
            step = moves.get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def plain(self, text: str) -> int:
        return sum(self.run(p.encode()) for p in self.pattern.findall(text))

    def word(self, word: str) -> int:
        """Tokens of a text between two borders."""
        if self.special is not None and self.first_special in word:
            return sum(map(self.plain, self.special.split(word))) + len(self.special.findall(word))
        return self.plain(word)

    WORD = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.WORD.findall(text)))

    BORDER = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, count, tail); without a border the head is all and the count None."""
        first = self.BORDER.search(text)
        if first is None:
            return text, None, ""
        at = max(m.start() for m in self.BORDER.finditer(text))
        return text[: first.start()], self.count(text[first.start(): at]), text[at:]

    def compose(self, x: tuple, y: tuple) -> tuple[str, int | None, str]:
        (h1, n1, t1), (h2, n2, t2) = x, y
        if n1 is None and n2 is None:
            joined = h1 + h2
            return self.chunk_map(joined) if self.BORDER.search(joined) else (joined, None, "")
        if n1 is None:
            return h1 + h2, n2, t2
        if n2 is None:
            return h1, n1, t1 + h2
        return h1, n1 + self.count(t1 + h2) + n2, t2


def transducer(spec: bytes) -> Transducer:
    """One transducer a worker process; its states serve all its tasks."""
    return held(("transducer", hash(spec)), lambda: Transducer(spec))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:  # a vocabulary: a few MB, sent to every executor once
        spec = spark.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      F.monotonically_increasing_id().alias("row"))
    src = src.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batches):
        t = transducer(spec.value)
        for batch in batches:
            for b in slices(batch, "text"):
                n = [t.count(x) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                                 ["id", "n_bytes", "n_tokens"])

    # a text of at most chunk_chars characters is one chunk
    long_text = F.char_length("text") > chunk_chars
    short = src.where(~long_text).select("id", "text", "n_bytes").mapInArrow(whole, "id long, n_bytes long, n_tokens long")

    def maps(batches):
        t = transducer(spec.value)
        for batch in batches:
            for b in slices(batch, "chunk"):
                got = [t.chunk_map(x) for x in b.column("chunk").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("row"), b.column("n_bytes"), b.column("k"), b.column("chunks"),
                     pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()),
                     pa.array([g[2] for g in got], pa.string())],
                    ["id", "row", "n_bytes", "k", "chunks", "head", "n", "tail"])

    fields = "id long, row long, n_bytes long, k long, chunks long, head string, n long, tail string"

    def compose(_key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        t = transducer(spec.value)
        group = group.sort_values("k")
        total = None
        for h, n, tail in zip(group["head"], group["n"], group["tail"], strict=True):
            x = (h, None if pd.isna(n) else int(n), tail)
            total = x if total is None else t.compose(total, x)
        one = group.drop(columns="g").iloc[:1].assign(head=total[0], n=total[1], tail=total[2])
        return one.assign(k=one["k"] // ARITY, chunks=(one["chunks"] + ARITY - 1) // ARITY)

    def close(batches):
        t = transducer(spec.value)
        for b in batches:
            n = [t.count(h) + (m or 0) + t.count(tail) for h, m, tail in
                 zip(*(b.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    # the longest text sets the number of rounds: each composes ARITY neighbouring maps
    longest = src.agg(F.max(F.char_length("text"))).first()[0] or 0
    chunks = F.ceil(F.char_length("text") / F.lit(chunk_chars)).cast("long")
    level = (src.where(long_text).withColumn("chunks", chunks)
             .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .withColumn("chunk", F.substr("text", (F.col("k") * chunk_chars + 1).cast("int"), F.lit(chunk_chars)))
             .select("id", "row", "n_bytes", "k", "chunks", "chunk")
             .repartition(F.col("row"), F.col("k")).mapInArrow(maps, fields))
    n = -(-longest // chunk_chars)
    while n > 1:
        level = level.withColumn("g", F.floor(F.col("k") / ARITY)).groupBy("row", "g").applyInPandas(compose, fields)
        n = -(-n // ARITY)
    out = short
    if longest > chunk_chars:
        out = short.union(level.mapInArrow(close, "id long, n_bytes long, n_tokens long"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
