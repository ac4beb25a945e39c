"""A compressed full-text index over sequences of word ids, searched in many lanes at once.

The transform is sorted to 64 words, more than the longest pattern asked for; that
suffices for backward search, whose intervals depend on as many words only. Ranks are
answered by a wavelet matrix of bit vectors with a count for each 64 bits.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Sorted depth of the suffixes: a power of two.
DEPTH = 64
#: Places of a grid of lanes that are searched together.
CELLS = 1 << 20


class BitVector:
    """Bits with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class FmIndex:
    """Index over texts (arrays of ids from 1), each with an owner; smaller owners win."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, longest: int):
        if longest >= DEPTH:
            raise ValueError(f"patterns have fewer than {DEPTH} words")
        self.longest = longest
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int((sizes + 1).sum())
        text = np.zeros(n, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        for s, t in zip(starts.tolist(), texts, strict=True):
            text[s : s + len(t)] = t
        owner = np.repeat(np.asarray(owners, np.int64), sizes + 1)
        self.n, self.sigma = n, int(text.max(initial=0)) + 1
        # prefix doubling; place n is the empty suffix, which sorts first
        rank = np.append(text + 1, 0)
        ranks = {1: rank}
        size = 1
        order = np.argsort(rank, kind="stable")
        while size < DEPTH:
            shifted = np.zeros(n + 1, np.int64)
            shifted[: max(0, n + 1 - size)] = rank[size:]
            key = rank * (n + self.sigma + 2) + shifted
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n + 1, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            size *= 2
            ranks[size] = rank
        self._order, self._ranks = order, ranks
        bwt = np.append(text, 0)[order - 1]  # the suffix at 0 is preceded by the end, a 0 as every border
        counts = np.bincount(bwt, minlength=self.sigma)
        # suffixes by their first word: the empty one, then the borders
        first = np.bincount(text, minlength=self.sigma)
        self.first = np.concatenate([[1], 1 + np.cumsum(first)])[: self.sigma].astype(np.int64)
        self.counts = counts
        self._levels(bwt)
        same = self._lcp_at_least(longest)
        group = np.cumsum(~same) - 1  # suffixes that agree on `longest` words
        begin = np.flatnonzero(~same)
        self.low, self.high = begin[group], np.append(begin[1:], n + 1)[group]
        owned = np.append(owner, np.iinfo(np.int64).max)[order]
        self.least = np.minimum.reduceat(owned, begin)[group]

    def _levels(self, bwt: np.ndarray) -> None:
        self.bits = max(1, (self.sigma - 1).bit_length())
        self.vectors: list[BitVector] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.vectors.append(BitVector(bit.astype(np.uint8)))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, v in zip(range(self.bits - 1, -1, -1), self.vectors, strict=True):
            ones = v.rank1(i)
            i = np.where((c >> level) & 1, v.zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Backward step: the suffixes before place i that begin with c once it is put before them."""
        return self.first[c] + self._descend(c, i) - self.base[c]

    def _agree(self, p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether the suffixes at p and q agree on so many words."""
        half = 1 << (size.bit_length() - 1)
        r = self._ranks[half]
        ok = r[p] == r[q]
        if size > half:
            at = lambda x: np.minimum(x + size - half, self.n)
            ok &= r[at(p)] == r[at(q)]
        return ok

    def _lcp_at_least(self, size: int) -> np.ndarray:
        out = np.zeros(self.n + 1, bool)
        out[1:] = self._agree(self._order[1:], self._order[:-1], size)
        return out

    @cached_property
    def _parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common prefixes of neighbours (at most `longest`), and for each place the nearest smaller ones around it."""
        lcp = np.zeros(self.n + 2, np.int64)
        for size in range(1, self.longest + 1):
            lcp[1:-1] += self._lcp_at_least(size)[1:]
        lcp[0] = lcp[-1] = -1
        at = np.arange(self.n + 2)
        before, after = np.zeros(self.n + 2, np.int64), np.full(self.n + 2, self.n + 1)
        for v in np.unique(lcp[1:-1]).tolist():
            smaller = lcp < v
            here = lcp == v
            before[here] = np.maximum.accumulate(np.where(smaller, at, 0))[here]
            after[here] = np.minimum.accumulate(np.where(smaller, at, self.n + 1)[::-1])[::-1][here]
        return lcp, before, after

    def _shorten(self, l: np.ndarray, r: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
        """Parent interval of [l, r): the longest shorter prefix with more suffixes."""
        lcp, before, after = self._parents
        k = np.where(lcp[l] >= lcp[r], l, r)
        depth = np.maximum(lcp[k], 0)
        whole = depth == 0
        return np.where(whole, 0, before[k]), np.where(whole, self.n + 1, after[k]), np.minimum(depth, m)

    def matching_statistics(self, lanes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each place of each lane: the longest match that begins there (at most `longest`
        words) and, where that is reached, the smallest owner of such a place (else -1)."""
        stats: list[np.ndarray] = [np.zeros(0, np.int16)] * len(lanes)
        owners: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lanes)
        by_length = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
        # a grid is as long as its longest lane: long ones go in few lanes at a time
        while by_length:
            some = max(1, CELLS // max(1, len(lanes[by_length[0]])))
            self._statistics(lanes, by_length[:some], stats, owners)
            by_length = by_length[some:]
        return stats, owners

    def _statistics(self, every: list[np.ndarray], order: list[int], stats: list[np.ndarray], owners: list[np.ndarray]) -> None:
        """The same for some lanes, the longest first."""
        lanes = [every[i] for i in order]
        sizes = np.array([len(x) for x in lanes], np.int64)
        most = int(sizes.max(initial=0))
        # by distance from the end: step t holds the lanes that are longer than t, which come first
        live = np.searchsorted(-sizes, -np.arange(most), "left")
        grid = np.zeros((most, len(lanes)), np.int64)
        for j, x in enumerate(lanes):
            grid[: len(x), j] = x[::-1]
        stat, least = np.zeros((most, len(lanes)), np.int16), np.full((most, len(lanes)), -1, np.int64)
        l, r, m = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n + 1, np.int64), np.zeros(len(lanes), np.int64)  # noqa: E741
        for t in range(most):
            k = int(live[t])
            c = grid[t, :k]
            todo = np.arange(k)
            known = (c > 0) & (c < self.sigma)
            l[:k][~known], r[:k][~known], m[:k][~known] = 0, self.n + 1, 0
            todo = todo[known]
            while len(todo):
                cc, size = c[todo], len(todo)
                both = self.step(np.concatenate([cc, cc]), np.concatenate([l[todo], r[todo]]))
                a, b = both[:size], both[size:]
                good = a < b
                done = todo[good]
                l[done], r[done] = a[good], b[good]
                m[done] = np.minimum(m[done] + 1, self.longest)
                todo = todo[~good]
                if len(todo):
                    todo_short = m[todo] > 0  # an id that is nowhere in the index stays unmatched
                    none = todo[~todo_short]
                    l[none], r[none] = 0, self.n + 1
                    todo = todo[todo_short]
                    l[todo], r[todo], m[todo] = self._shorten(l[todo], r[todo], m[todo])
            full = np.flatnonzero(m[:k] == self.longest)
            at = l[full]
            least[t, full] = self.least[at]
            l[full], r[full] = self.low[at], self.high[at]
            stat[t, :k] = m[:k]
        for j, i in enumerate(order):
            # copies, so that the grid can go
            stats[i] = stat[: sizes[j], j][::-1].copy()
            owners[i] = least[: sizes[j], j][::-1].copy()
