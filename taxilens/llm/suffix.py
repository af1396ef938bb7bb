"""Induced sorting of suffixes with common-prefix values, in memory.

Strings are joined, each closed by a separator that is smaller than any
symbol and differs from every other separator, so comparisons end there.

S* suffixes (an S position after an L position) are named by sorting their
substrings up to the next S*.  Where the names are unique, they are the
ranks; where there are fewer than BUCKETS, the names are sorted by
recursion.  A shard of more than a few KB has more names, so its S* suffixes
are ranked by prefix doubling of the names; the induction from them is one
level.  One ascending scan induces the L suffixes and one descending scan
the S suffixes.  Each scan reads and feeds priority queues, one for each
first symbol: what is put into one comes in order, so the smallest is always
at its head.  Queue entries are (position, common prefix with the entry
before); the common prefix of two induced suffixes is one more than the least
value scanned between their successors.

Queues keep ``memory`` entries and write the rest to unnamed temporary
files, read back in order.  Nothing else is external: the text, its types and
names, the scanned suffixes, sa and lcp are arrays in memory (README has
figures).  Callers bound the shard; see SHARD_BYTES in :mod:`repeats`.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
#: Entries that the queues of one scan keep in memory.
MEMORY = 1 << 22
#: Names up to this are buckets of the recursion.
BUCKETS = 1 << 10
FAR = np.int64(1) << 40


class Queues:
    """FIFO queues of (position, lcp), one per symbol, spilling to disk."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.held: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.size = np.zeros(symbols, np.int64)
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.memory, self.inside, self.file = memory, 0, None

    def put(self, c: int, entries: np.ndarray) -> None:
        self.held[c].append(entries)
        self.inside += len(entries)
        if self.inside > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffix-queue-")
        for c, parts in enumerate(self.held):
            for p in parts:
                self.spilled[c].append((self.file.seek(0, 2), len(p)))
                self.file.write(p.tobytes())
            self.held[c] = []
        self.inside = 0

    def take(self, c: int) -> Iterator[np.ndarray]:
        """All entries of a symbol's queue as of now, in chunks; it is empty after."""
        disk, parts = self.spilled[c], self.held[c]
        self.spilled[c], self.held[c] = [], []
        self.inside -= sum(len(p) for p in parts)
        for at, n in disk:
            for i in range(0, n, CHUNK):
                self.file.seek(at + 16 * i)
                yield np.frombuffer(self.file.read(16 * min(CHUNK, n - i)), np.int64).reshape(-1, 2)
        if parts:
            whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
            for i in range(0, len(whole), CHUNK):
                yield whole[i:i + CHUNK]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(v[lo..hi]) of each pair, both ends included."""
    span = hi - lo + 1
    out = np.empty(len(lo), v.dtype)
    level, width = v, 1
    exp = np.frexp(span.astype(np.float64))[1] - 1
    for e in range(int(exp.max(initial=0)) + 1):
        at = np.flatnonzero(exp == e)
        if len(at):
            out[at] = np.minimum(level[lo[at]], level[hi[at] - width + 1])
        if e < int(exp.max(initial=0)):
            level = np.minimum(level[:-width], level[width:])
            width *= 2
    return out


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S positions, and how often the symbol repeats from each position on.
    Separators (0) are S."""
    n = len(t)
    change = np.empty(n, bool)
    change[-1] = True
    change[:-1] = (t[:-1] != t[1:]) | (t[:-1] == 0)
    at = np.flatnonzero(change)
    up = np.ones(len(at), bool)
    up[:-1] = (t[at[:-1]] < t[at[:-1] + 1]) | (t[at[:-1]] == 0)
    size = np.diff(np.concatenate(([-1], at)))
    run = np.repeat(at, size) - np.arange(n) + 1
    return np.repeat(up, size), run


def _name(t: np.ndarray, s: np.ndarray, star: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Dense names, in order, of the substrings [star, end] of symbols and
    types; separators get the first names, by place."""
    sym = t.astype(np.int64) * 2 + s
    rank = np.zeros(len(star), np.int64)
    closed = t[star] == 0
    rank[closed] = np.arange(np.count_nonzero(closed))
    rank[~closed] = np.count_nonzero(closed)
    live = np.flatnonzero(~closed)
    step = 0
    while len(live):
        i = star[live] + step
        inside = i <= end[live]
        key = np.where(inside, sym[np.minimum(i, len(t) - 1)] + 1, 0)
        for j in range(1, 3):  # three symbols at a time
            more = i + j <= end[live]
            key = key * (1 << 20) + np.where(more, sym[np.minimum(i + j, len(t) - 1)] + 1, 0) if t.dtype.itemsize <= 2 else key
        width = 3 if t.dtype.itemsize <= 2 else 1
        order = np.lexsort((key, rank[live]))
        r, k = rank[live][order], key[order]
        group = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        part = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])))
        # a part's rank: its group's rank and the members before it in the group
        first = np.maximum.accumulate(np.where(part, np.arange(len(r)), 0))
        base = np.repeat(group, np.diff(np.append(group, len(r))))
        rank[live[order]] = r + first - base
        size = np.diff(np.append(np.flatnonzero(part), len(r)))
        tied = np.repeat(size > 1, size)
        live = live[order[tied]]
        step += width
        live = live[star[live] + step <= end[live]]
    return np.unique(rank, return_inverse=True)[1]


def _doubling(name: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a sequence of names; a suffix ends with the
    first closed place, whose name is unique."""
    n, step = len(name), 1
    stop = np.append(np.flatnonzero(closed), n)
    last = np.minimum(np.repeat(stop, np.diff(stop, prepend=-1))[:n], n - 1)
    size = np.bincount(name)
    rank = (np.cumsum(size) - size)[name]  # how many are smaller
    live = np.flatnonzero(size[name] > 1)  # those that are unique keep their ranks
    while len(live):
        key = rank[live] * np.int64(n + 1) + rank[np.minimum(live + step, last[live])]
        order = np.argsort(key)
        key, live = key[order], live[order]
        was = rank[live]
        part = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], was[1:] != was[:-1]))
        at = np.arange(len(live))
        rank[live] = was + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.append(part[1:], True)
        live = live[~alone]
        step *= 2
    return rank


def _fours(t: np.ndarray) -> np.ndarray:
    """Four symbols of 16 bits from each place on, or 0 where one of them is."""
    out, whole = np.zeros(len(t), np.uint64), np.ones(len(t), bool)
    padded = np.append(t, np.zeros(3, t.dtype))
    for i in range(4):
        symbol = padded[i:i + len(t)]
        out |= symbol.astype(np.uint64) << np.uint64(16 * i)
        whole &= symbol != 0
    return np.where(whole, out, np.uint64(0))


def _star_lcp(t: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in ``pos``; the first is 0."""
    out = np.zeros(len(pos), np.int64)
    for symbols, width in [(_fours(t), 4), (t, 1)] if t.dtype == np.uint16 else [(t, 1)]:
        live = np.arange(1, len(pos))
        while len(live):
            a, b = symbols[pos[live] + out[live]], symbols[pos[live - 1] + out[live]]
            live = live[(a == b) & (a != 0)]
            out[live] += width
    return out


class _Scan:
    """Puts the predecessors of scanned suffixes into queues, with their lcp."""

    def __init__(self, t, s, want_s: bool, symbols: int, memory: int):
        self.t, self.s, self.want = t, s, want_s
        self.q = Queues(symbols, memory)
        self.since = np.full(symbols, FAR)  # least lcp scanned since the symbol's last entry
        self.fresh = np.ones(symbols, bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Scanned suffixes and their lcp with the one scanned before."""
        prev = np.maximum(pos - 1, 0)
        c = self.t[prev]
        ok = np.flatnonzero((pos > 0) & (self.s[prev] == self.want) & (c != 0))
        if len(ok):
            ok = ok[np.argsort(c[ok], kind="stable")]
            cc = c[ok]
            head = np.concatenate(([True], cc[1:] != cc[:-1]))
            lo = np.concatenate(([0], ok[:-1] + 1))
            lo[head] = 0
            low = range_min(lcp, lo, ok)
            first = np.flatnonzero(head)
            names = cc[first]
            low[first] = np.minimum(low[first], self.since[names])
            low = low + 1
            low[first[self.fresh[names]]] = 0
            self.fresh[names] = False
            entries = np.stack((prev[ok], low), axis=1)
            ends = np.append(first[1:], len(ok))
            self.since = np.minimum(self.since, lcp.min())
            tail = ok[ends - 1]
            left = np.full(len(names), FAR)
            some = tail + 1 < len(lcp)
            left[some] = range_min(lcp, tail[some] + 1, np.full(np.count_nonzero(some), len(lcp) - 1))
            self.since[names] = left
            for k, a, b in zip(names.tolist(), first.tolist(), ends.tolist(), strict=True):
                self.q.put(k, entries[a:b])
        elif len(lcp):
            self.since = np.minimum(self.since, lcp.min())


def sort_suffixes(t: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp) of a text of symbols, 0 closing each string and the last.
    lcp[k] is the common prefix of suffixes sa[k-1] and sa[k], up to but not
    including a separator."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, run = _types(t)
    star = np.flatnonzero(s & np.concatenate(([True], ~s[:-1])) | (t == 0))
    closed = t[star] == 0
    end = np.where(closed, star, np.append(star[1:], n - 1))
    name = _name(t, s, star, end)
    if name.max(initial=0) + 1 == len(star):
        order = np.argsort(name)
    elif name.max() - np.count_nonzero(closed) < BUCKETS:
        down = np.where(closed, 0, name - np.count_nonzero(closed) + 1).astype(np.uint16 if BUCKETS < 1 << 15 else np.int64)
        order = sort_suffixes(down, memory)[0]
    else:
        order = np.argsort(_doubling(name, closed))
    pos = star[order]
    keep = t[pos] != 0
    seps = pos[~keep]
    pos = pos[keep]
    plcp = _star_lcp(t, pos)
    symbols = int(t.max()) + 1
    bounds = np.searchsorted(t[pos], np.arange(symbols + 1))

    # ascending: L suffixes
    up = _Scan(t, s, False, symbols, memory)
    up.feed(seps, np.zeros(len(seps), np.int64))
    L: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(1, symbols):
        last = -1
        while True:
            got = False
            for e in up.q.take(c):
                got = True
                lcp = e[:, 1].copy()
                if last < 0:
                    lcp[0] = 0
                L[c].append(np.stack((e[:, 0], lcp), axis=1))
                last = int(e[-1, 0])
                up.feed(e[:, 0], lcp)
            if not got:
                break
        a, b = int(bounds[c]), int(bounds[c + 1])
        for i in range(a, b, CHUNK):
            lcp = plcp[i:min(i + CHUNK, b)].copy()
            if i == a:
                lcp[0] = min(run[last], run[pos[a]]) if last >= 0 else 0
            up.feed(pos[i:min(i + CHUNK, b)], lcp)
    up.q.close()

    # descending: S suffixes; an entry's lcp is with the one scanned before, which is larger
    down_scan = _Scan(t, s, True, symbols, memory)
    S: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols - 1, 0, -1):
        last = -1
        while True:
            got = False
            for e in down_scan.q.take(c):
                got = True
                lcp = e[:, 1].copy()
                if last < 0:
                    lcp[0] = 0
                S[c].append(np.stack((e[:, 0], lcp), axis=1))
                last = int(e[-1, 0])
                down_scan.feed(e[:, 0], lcp)
            if not got:
                break
        if L[c]:
            e = np.concatenate(L[c])
            p = e[::-1, 0]
            lcp = np.concatenate(([min(run[last], run[p[0]]) if last >= 0 else 0], e[:0:-1, 1]))
            for i in range(0, len(p), CHUNK):
                down_scan.feed(p[i:i + CHUNK], lcp[i:i + CHUNK])
    down_scan.q.close()

    sa, out = [seps], [np.zeros(len(seps), np.int64)]
    for c in range(1, symbols):
        last = -1
        if L[c]:
            e = np.concatenate(L[c])
            sa.append(e[:, 0])
            out.append(e[:, 1])
            last = int(e[-1, 0])
        if S[c]:
            e = np.concatenate(S[c])[::-1]
            sa.append(e[:, 0])
            out.append(np.concatenate(([min(run[last], run[e[0, 0]]) if last >= 0 else 0], e[:-1, 1])))
    return np.concatenate(sa), np.concatenate(out)
