"""Compressed FM-index over a shard, with backward search for many streams
at once.

The last column of the sorted rotations is held as a wavelet matrix: for
each bit of a symbol, a bit vector in words of 64 with a count before each
word.  One step of backward search is two rank queries per bit.  Strings are
closed by separators that never match.
"""

from __future__ import annotations

import numpy as np

from .common import U


class BitVector:
    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros((self.n >> 6) + 1, U)
        self.words.view(np.uint8)[:len(raw)] = raw
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.zeros = self.n - int(np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        part = self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1))
        return self.before[w] + np.bitwise_count(part)


def ranked_suffixes(t: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, and the ranks at depths 1, 2, 4, ..  Rows end
    at their separators, each a symbol of its own."""
    n = len(t)
    stop = np.repeat(np.cumsum(size + 1) - 1, size + 1)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    depths, step = [rank], 1
    while step < int(size.max(initial=0)) + 1:
        nxt = rank[np.minimum(np.arange(n) + step, stop)]
        rank = np.unique(rank * np.int64(n + 1) + nxt, return_inverse=True)[1].astype(np.int64)
        depths.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), depths


class FMIndex:
    """Index of strings of symbols 0 .. symbols-1."""

    def __init__(self, strings: list[np.ndarray], symbols: int):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.symbols = symbols
        count = len(strings)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        t = np.zeros(int(self.size.sum()) + count, np.int64)
        seps = self.start + self.size
        inside = np.ones(len(t), bool)
        inside[seps] = False
        t[inside] = np.concatenate(strings) + count if count else []
        t[seps] = np.arange(count)  # one symbol each, so that comparisons end
        self.sa, self.depths = ranked_suffixes(t, self.size)
        last = t[self.sa - 1]  # the symbol before the first suffix is the last separator
        last = np.where(last < count, 0, last - count + 1)  # all separators are one symbol here, never asked for
        self.owner = np.repeat(np.arange(count), self.size + 1)
        first = t[self.sa]
        self.begin = np.searchsorted(first, np.arange(symbols + 1) + count)
        self.n = len(t)
        self.levels: list[BitVector] = []
        self.bits = max(1, int(symbols).bit_length())
        col = last
        for b in range(self.bits - 1, -1, -1):
            bit = ((col >> b) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            col = np.concatenate((col[~bit], col[bit]))

    def _rank(self, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of symbol c in the last column before i, and before j."""
        c = c + 1
        s = np.zeros_like(i)
        for level, v in enumerate(self.levels):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            both = v.ones(np.concatenate((s, i, j))).reshape(3, -1)
            s, i, j = (np.where(one, v.zeros + x, p - x) for x, p in zip(both, (s, i, j), strict=True))
        return i - s, j - s

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes start with c and go on as those of [lo, hi)."""
        a, b = self._rank(c, lo, hi)
        return self.begin[c] + a, self.begin[c] + b

    def depth_run(self, depth: int) -> np.ndarray:
        """Number of the run of rows that agree in their first ``depth``
        symbols.  Rows with less before their end are runs of their own."""
        k = depth.bit_length() - 1
        r = self.depths[min(k, len(self.depths) - 1)]
        stop = np.repeat(self.start + self.size, self.size + 1)
        at = self.sa
        key = np.stack((r[at], r[np.minimum(at + depth - (1 << k), stop[at])]))
        return np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))))

    def matching(self, streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streams against the index, cut at ``depth``:
        (stream, place, run) of every place whose next ``depth`` symbols occur
        in the index, run as in :meth:`depth_run`.

        All streams are read from their ends together.  A symbol that extends
        the match narrows its rows.  Once a match has ``depth`` symbols, its
        run is noted, and only that; rows keep narrowing with what follows.
        Where a symbol fails, the longest match that it can extend is found
        again from the symbols read last.
        """
        run = self.depth_run(depth)
        order = np.argsort([-len(s) for s in streams], kind="stable")
        longest = len(streams[order[0]]) if len(streams) else 0
        pad = np.full((len(streams), longest), -1, np.int64)
        for k, i in enumerate(order):
            if len(streams[i]):
                pad[k, :len(streams[i])] = streams[i][::-1]
        lengths = np.array([len(streams[i]) for i in order], np.int64)
        lo, hi, have = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        out = [[], [], []]
        for step in range(longest):
            live = int(np.searchsorted(-lengths, -step))
            c = pad[:live, step]
            known = (c >= 0) & (c < self.symbols)
            a, b = self.extend(np.where(known, c, 0), lo[:live], hi[:live])
            fits = known & (a < b)
            lo[:live], hi[:live] = np.where(fits, a, lo[:live]), np.where(fits, b, hi[:live])
            have[:live] += fits
            for k in np.flatnonzero(~fits):
                lo[k], hi[k], have[k] = self._again(pad[k, :step + 1], int(have[k]))
            full = np.flatnonzero(have[:live] >= depth)
            out[0].append(order[full])
            out[1].append(lengths[full] - 1 - step)
            out[2].append(run[lo[full]])
        s, p, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        by = np.lexsort((p, s))
        return s[by], p[by], r[by]

    def _again(self, read: np.ndarray, have: int) -> tuple[int, int, int]:
        """The longest match of the symbols just read, newest last, after a
        match of ``have`` failed to take the newest."""
        for length in range(have, 0, -1):
            lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
            for c in read[len(read) - length:]:
                if not 0 <= c < self.symbols:
                    lo = hi
                    break
                lo, hi = self.extend(np.array([c]), lo, hi)
                if lo[0] >= hi[0]:
                    break
            if lo[0] < hi[0]:
                return int(lo[0]), int(hi[0]), length
        return 0, self.n, 0
