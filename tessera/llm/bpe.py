"""Merge tables of byte-pair vocabularies and the border rule.

A sequence of tokens is what byte-pair merging returns for a string exactly
when each token is what merging returns for itself and each neighbouring
pair is what merging returns for the two together: merges are chosen by a
static priority, so what happens across one border does not depend on what
lies further away. ``Merges.fits(a, b)`` decides the pair. Walking the right
edge of a's merge tree against the left edge of b's, the border falls only
if some cross merge has priority over the merges that consume both sides.
"""

from __future__ import annotations

import numpy as np

BASE = -1  # rank of a symbol that needs no merge
NEVER = 1 << 40
MAX_ANSWERS = 150_000


class Merges:
    """``pairs``: (left id, right id) -> (rank, merged id); ``symbols``: token
    id -> its base symbols' ids."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], symbols: dict[int, tuple[int, ...]]):
        self.pairs, self.symbols = pairs, symbols
        self._edges: dict[int, tuple[tuple, tuple] | None] = {}
        self._fits: dict[int, bool] = {}
        self._tables: tuple | None = None

    def merge(self, ids: list[int]) -> tuple[list[int], dict]:
        """Plain merging by rank, leftmost first; also the merge trees."""
        seq: list = [(i, BASE, None, None) for i in ids]
        pairs = self.pairs
        while len(seq) > 1:
            best = None
            for k in range(len(seq) - 1):
                found = pairs.get((seq[k][0], seq[k + 1][0]))
                if found is not None and (best is None or found[0] < best[0]):
                    best = (found[0], k, found[1])
            if best is None:
                break
            rank, k, merged = best
            seq[k: k + 2] = [(merged, rank, seq[k], seq[k + 1])]
        return [s[0] for s in seq], seq

    def edges(self, token: int):
        """(right edge, left edge) of the token's merge tree: lists of (id,
        own rank, rank of the merge that consumes it); None if merging the
        token's symbols does not give the token."""
        if token not in self._edges:
            ids, trees = self.merge(list(self.symbols[token]))
            if ids != [token]:
                self._edges[token] = None
            else:
                found = []
                for side in (3, 2):
                    node, until, edge = trees[0], NEVER, []
                    while node is not None:
                        edge.append((node[0], node[1], until))
                        until, node = node[1], node[side]
                    found.append(tuple(edge))
                self._edges[token] = tuple(found)
        return self._edges[token]

    def fits(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > MAX_ANSWERS:
                self._fits.clear()
            known = self._fits[key] = self._decide(a, b)
        return known

    def _decide(self, a: int, b: int) -> bool:
        ea, eb = self.edges(a), self.edges(b)
        if ea is None or eb is None:
            return False
        pairs = self.pairs
        for left, born_l, until_l in ea[0]:
            for right, born_r, until_r in eb[1]:
                found = pairs.get((left, right))
                if found is None:
                    continue
                rank = found[0]
                if rank <= max(born_l, born_r):  # a merge ranked before its parts: order of events decides
                    return self.merge([*self.symbols[a], *self.symbols[b]])[0] == [a, b]
                # at equal ranks the leftmost pair merges first
                if rank < until_l and rank <= until_r:
                    return False
        return True

    def fits_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for arrays of token ids: all pairs of edge nodes are looked up at once,
        and only borders where the order of events decides are merged one by one."""
        if self._tables is None:
            self._tables = self._edge_tables()
        keys, ranks, ok, (first_r, many_r, right), (first_l, many_l, left) = self._tables
        good = ok[a] & ok[b]
        wide = many_l[b]
        many = np.where(good, many_r[a] * wide, 0)
        pair = np.repeat(np.arange(len(a)), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        i, j = first_r[a][pair] + k // wide[pair], first_l[b][pair] + k % wide[pair]
        key = right[i, 0] << 24 | left[j, 0]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        met = np.flatnonzero(keys[at] == key) if len(keys) else np.empty(0, np.int64)
        rank, pair, right, left = ranks[at[met]], pair[met], right[i[met]], left[j[met]]
        events = rank <= np.maximum(right[:, 1], left[:, 1])
        good[pair[~events & (rank < right[:, 2]) & (rank <= left[:, 2])]] = False
        for p in np.unique(pair[events]).tolist():
            good[p] = self._decide(int(a[p]), int(b[p]))
        return good

    def _edge_tables(self) -> tuple:
        """Sorted pairs with their ranks; which ids are tokens; first row, length and rows of their right and left edges."""
        keys = np.array([a << 24 | b for a, b in self.pairs], np.int64)
        by = np.argsort(keys)
        ranks = np.array([r for r, _ in self.pairs.values()], np.int64)[by]
        ok = np.zeros(max(self.symbols, default=0) + 1, bool)
        sides = []
        for side in (0, 1):
            many, rows = np.zeros(len(ok), np.int64), []
            for t in sorted(self.symbols):
                edges = self.edges(t)
                if edges is not None:
                    ok[t], many[t] = True, len(edges[side])
                    rows += edges[side]
            sides.append((np.cumsum(many) - many, many, np.array(rows, np.int64).reshape(-1, 3)))
        return keys[by], ranks, ok, *sides
