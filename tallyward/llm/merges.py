"""Byte-pair merging of many short words at once, in numpy.

Words of one length form a matrix of symbols, and every step applies to each row its pair
of lowest rank (the leftmost of equals), just as the merges would one word after another.
Each row loses one symbol a step, so rows stay equally long; rows without a pair that
merges are done and leave the matrix.
"""

from __future__ import annotations

import numpy as np

from .common import U64

#: Rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max


class _Ranks:
    """Rank of a pair of ids: an open-addressing table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            put = todo[free]
            put = put[np.unique(slot[put], return_index=True)[1]]
            self.keys[slot[put]], self.rank[slot[put]] = keys[put], put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            here = self.keys[at]
            same = here == keys[todo]
            out[todo[same]] = self.rank[at[same]]
            on = ~same & (here >= 0)
            todo = todo[on]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Merges:
    """``inner`` and ``last`` give the id of each byte inside and at the end of a word; ``pairs`` are (left, right, merged) by rank."""

    def __init__(self, inner: np.ndarray, last: np.ndarray, pairs: np.ndarray):
        self.inner, self.last, self.made = inner.astype(np.int32), last.astype(np.int32), pairs[:, 2].astype(np.int32)
        self.ranks = _Ranks(pairs[:, 0], pairs[:, 1])
        # ranks of two bytes, the second inside a word or at its end
        a, b = np.divmod(np.arange(256 * 512), 512)
        self.bytes = self.ranks(self.inner[a], np.where(b < 256, self.inner[b % 256], self.last[b % 256]))

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their first place for each word and the end) of adjacent words, none of them empty."""
        size = np.diff(offsets)
        counts = np.zeros(len(size), np.int64)
        done = []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            raw = data[offsets[rows][:, None] + np.arange(n)]
            sym = self.inner[raw]
            sym[:, -1] = self.last[raw[:, -1]]
            ends = np.zeros(max(n - 1, 0), np.int32)
            ends[-1:] = 256
            rank = self.bytes[raw[:, :-1].astype(np.int32) * 512 + raw[:, 1:] + ends]
            for r, s in self._merged(rows, sym, rank):
                counts[r] = s.shape[1]
                done.append((r, s))
        begin = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(begin[-1], np.uint32)
        for r, s in done:
            ids[begin[r][:, None] + np.arange(s.shape[1])] = s
        return ids, begin

    def _merged(self, rows: np.ndarray, sym: np.ndarray, rank: np.ndarray):
        """(rows, symbols) of words as they are done."""
        while len(rows) and rank.shape[1]:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            on = best < NONE
            if not on.all():
                yield rows[~on], sym[~on]
                rows, sym, rank, at, best = rows[on], sym[on], rank[on], at[on], best[on]
            n, width = sym.shape
            every, place = np.arange(n), np.arange(width - 1)
            sym = np.take_along_axis(sym, place + (place > at[:, None]), 1)
            sym[every, at] = self.made[best]
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), 1)
            r = np.flatnonzero(at > 0)
            rank[r, at[r] - 1] = self.ranks(sym[r, at[r] - 1], sym[r, at[r]])
            r = np.flatnonzero(at < width - 2)
            rank[r, at[r]] = self.ranks(sym[r, at[r]], sym[r, at[r] + 1])
        if len(rows):
            yield rows, sym
