"""Vectorised words, word hashes and n-gram hashes over UTF-8 bytes.

A word is a maximal run of bytes other than blank and 0x09-0x0D; A-Z are
folded to lower case when asked. Everything is numpy on Arrow buffers: no
Python object per word. Hashes are 64-bit polynomial hashes over random
byte codes, finalised by a mixer.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE_FOLDED = _CODE[FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LANE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 20
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, _BLOCK) + 1
    if "up" not in _POW or len(_POW["up"]) < n + 1:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"][:n], _POW["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
    """Byte starts and ends of the words, and per row the index of its first word."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | row_start[1:n]
    end = inside
    end[:-1] &= ~inside[1:] | row_start[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of each byte span; done in blocks of about 1 MB of text."""
    out = np.empty(len(starts), np.uint64)
    code = _CODE_FOLDED if fold else _CODE
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        block = data[base: ends[j - 1]]
        up, down = _powers(len(block))
        total = np.empty(len(block) + 1, np.uint64)
        total[0] = 0
        np.cumsum(code[block] * up, out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int):
    """Hashes of the n-grams of every row and per row the index of its first
    n-gram; a row of fewer than n words has none."""
    counts = np.diff(first)
    grams = np.maximum(counts - n + 1, 0)
    gfirst = np.concatenate([[0], np.cumsum(grams)])
    if len(hashes) < n:
        return np.empty(0, np.uint64), gfirst, np.empty(0, np.int64)
    at = np.arange(gfirst[-1]) + np.repeat(first[:-1] - gfirst[:-1], grams)  # index of the first word of each n-gram
    rolled = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        rolled += hashes[k: len(hashes) - n + 1 + k] * _LANE[k]
    return mix(rolled[at]), gfirst, at


def short_sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of fewer words than a shingle has."""
    total = np.uint64(0x51ED270B + len(hashes))
    with np.errstate(over="ignore"):
        for k, h in enumerate(hashes):
            total = total * np.uint64(0xA0761D6478BD642F) + h * _LANE[40 + k]
    return mix(np.array([total], np.uint64))[0]


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 to int64 keeping the order."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)
