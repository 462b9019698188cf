"""Token counts and SentencePiece pieces against the public libraries."""
import random
import tracemalloc

import numpy as np
import pytest

from tessera.llm.sentencepiece_codec import Codec, decode, encode
from tessera.llm.token_counts import Transducer, token_counts

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll", "<|endoftext|>", "<|endoft", "<s>", "é", "ß", "日本", "1", "23", "!!",
         chr(0x3000), chr(0x85), chr(0x1C), chr(0xA0), " \n", "the", "ing", chr(0x663), "😀", "\0", chr(0x200B), "’", "zzzz", "aaa"]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe(tokenizer_path):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def pieces(tokenizer_path):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_transducer_counts_as_the_library(bpe):
    path, library = bpe
    t = Transducer(open(path, "rb").read())
    cases = strings(5000, 1) + [f"a{chr(c)} {chr(c)}b1{chr(c)}2" for c in range(0x3100)]
    assert [t.count(x) for x in cases] == [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]


def test_chunk_maps_compose_to_the_whole(bpe):
    t = Transducer(open(bpe[0], "rb").read())
    for x in strings(500, 2):
        for size in (1, 3, 7):
            maps = [t.chunk_map(x[i:i + size]) for i in range(0, max(1, len(x)), size)]
            left = maps[0]
            for m in maps[1:]:
                left = t.compose(left, m)
            while len(maps) > 1:  # another bracketing
                maps = [t.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            for h, n, tail in (left, maps[0]):
                assert t.count(h) + (n or 0) + t.count(tail) == t.count(x)


def test_token_counts(spark, bpe, texts):
    path, library = bpe
    rows = [*texts.items(), (1, texts[1]), (-1, None), (-2, ""), (None, "a"), (-3, "x" * 3000), (-4, "word " * 5000), (-5, "<|endoftext|>" * 300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in token_counts(df, path, chunk_chars=500).collect()), key=str)
    want = []
    for i, x in rows:
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0), path).count() == 0


def test_codec_encodes_as_the_library(pieces):
    path, library = pieces
    codec = Codec(open(path, "rb").read())
    cases = strings(5000, 3) + ["", "▁", "a▁b"]
    assert [x.tolist() for x in codec.encode(cases)] == library.encode(cases)


def test_encode_decode(spark, pieces, texts):
    path, library = pieces
    rows = [*texts.items(), (1, texts[1]), (-1, None), (-2, ""), (None, " a  b "), (-3, "x" * 3000), (-4, "Wörter " * 4000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, label int")
    got = decode(encode(df, path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["label"] == 7 and r["decoded"] == r["text"]
        assert r["pieces"] == (None if r["text"] is None else library.encode(r["text"]))
    assert encode(df.limit(0), path).count() == 0


def test_batches_of_any_size(pieces):
    """New words of any total length, in a fresh codec and after a cached batch."""
    path, library = pieces
    raw = open(path, "rb").read()
    cases = ["x"[:n] + "dogs and cats in a row of words, éß日本!"[: max(0, n - 1)] for n in range(0, 41)]
    fresh = Codec(raw)
    for i, text in enumerate(cases):
        one = Codec(raw) if i < 16 else fresh
        assert [x.tolist() for x in one.encode([text])] == [library.encode(text)], text
    fresh.encode(["hello"])
    for text in ["hello dogs", "a b", "x", "", "hello q", "hello zq zq"]:
        assert [x.tolist() for x in fresh.encode([text])] == [library.encode(text)]
    for text in strings(2000, 5):
        assert fresh.encode([text])[0].tolist() == library.encode(text)


def test_memory_of_a_batch_is_a_few_times_its_text(pieces):
    """The words of a batch are not held all at once, and the arrays of an index are small."""
    raw, rng = open(pieces[0], "rb").read(), random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbg", k=8)) for _ in range(24000)]
    texts = [" ".join(words[k:k + 80] + ["the"] * 2000) for k in range(0, 24000, 80)]
    codec = Codec(raw)
    codec.encode(["warm up"])
    tracemalloc.start()
    try:
        got = codec.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [len(x) for x in got] == [len(x) for x in pieces[1].encode(texts)]
    assert peak < 15 * sum(map(len, texts))


def test_borders_are_decided_together(pieces, monkeypatch):
    """Borders of new words are looked up as arrays, with the answers of the scalar rule;
    only those where the order of merges decides are merged one by one."""
    rng, codec = random.Random(11), Codec(open(pieces[0], "rb").read())
    merges, asked, alone = codec.merges, [], []
    together, decide = merges.fits_all, merges._decide
    monkeypatch.setattr(merges, "fits_all", lambda a, b: asked.append((a, b)) or together(a, b))
    monkeypatch.setattr(merges, "_decide", lambda a, b: alone.append((a, b)) or decide(a, b))
    texts = [" ".join("".join(rng.choices("etaoinshrdlucmfwypvbgé日", k=9)) for _ in range(300)) for _ in range(10)]
    assert [x.tolist() for x in codec.encode(texts)] == pieces[1].encode(texts)
    borders = [(int(a), int(b)) for x, y in asked for a, b in zip(x, y, strict=True)]
    assert len(borders) > 3000 and len(alone) < len(borders) / 4
    assert [bool(g) for x, y in asked for g in together(x, y)] == [decide(a, b) for a, b in borders]
    tokens = sorted(merges.symbols)
    some = np.array([[rng.choice(tokens), rng.choice(tokens)] for _ in range(20000)])
    assert together(some[:, 0], some[:, 1]).tolist() == [decide(a, b) for a, b in some.tolist()]


def test_a_failed_batch_leaves_no_half_known_words(pieces):
    codec = Codec(open(pieces[0], "rb").read())
    with pytest.raises(UnicodeEncodeError):
        codec.encode(["new words", "\ud800"])
    assert codec.encode(["new words"])[0].tolist() == pieces[1].encode("new words")


def test_existing_columns_are_refused(spark, pieces):
    df = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, pieces int")
    with pytest.raises(ValueError, match="pieces"):
        encode(df, pieces[0])
    other = encode(df, pieces[0], out="ids")
    with pytest.raises(ValueError, match="text"):
        decode(other, pieces[0], pieces_col="ids", out="text")
