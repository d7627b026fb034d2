"""External induced sorting of suffixes with common prefixes.

The suffixes of many strings (symbols above 0, each string ended by a 0) are sorted
by their first `depth` symbols, and neighbours in that order get the length of
their common prefix, up to MOST.  One level of the recursion:

1. Strings are read as runs of equal symbols.  A run is of type S if the next
   symbol is larger, else of type L; an S run after an L run is leftmost (S*).
2. The substrings from one S* run to the next are tuples that go through a priority
   queue; equal ones get equal names, in order, and neighbouring names their common
   prefix.  The strings of names are half as long at most: the recursion sorts them,
   and their common prefixes, counted in names, are turned into symbols.
3. Suffixes of type L are induced from the S* suffixes: the tuple of a suffix holds
   the runs up to the next S* run and the rank of that suffix.  A queue returns the
   tuples in order.  The common prefix of neighbours lies in the runs where they
   differ, or is that of the suffixes that induced them (a range minimum).
4. Suffixes of type S are induced from those of type L in the same way.

Memory is bounded by `budget` items, however large the input is: queues sort runs of
that many tuples, write them to an unnamed file and merge them block by block; texts,
names, ranks, orders and common prefixes are files too (Store), read by blocks of
whole strings.  Only positions that are asked for, and what induces them, take part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Tuples that a queue sorts at once, and longest array in memory.
BUDGET = 4_000_000
#: Symbols that are handled at once, so that they stay in cache.
BLOCK = 100_000
#: Common prefixes are counted up to MOST; longer runs than LONGEST_RUN aren't told apart,
#: so no depth may be larger.
MOST, LONGEST_RUN = 120, 60
_RUN_BITS = 7
_RUN = np.int64(127)


class Store:
    """Arrays that lie in unnamed files once they are longer than the budget."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.block = budget, min(budget, BLOCK)
        self.on_disk = 0

    def array(self, n: int, kind: type | str) -> np.ndarray:
        if n <= self.budget:
            return np.zeros(n, kind)
        self.on_disk += n * np.dtype(kind).itemsize
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of values among their distinct values."""
    code, distinct = pd.factorize(x)
    order = np.argsort(distinct)
    rank = np.empty(len(distinct), np.int64)
    rank[order] = np.arange(len(distinct))
    return rank[code], len(distinct)


def _order(words: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
    """The order of tuples (words, rank)."""
    code, n = _dense(words[0])
    for w in words[1:]:
        other, m = _dense(w)
        if m > 1:
            code, n = _dense(code * m + other)
    low = int(rank.min()) if len(rank) else 0
    bits = int(rank.max() - low).bit_length() if len(rank) else 0
    if n.bit_length() + bits < 63:
        return np.argsort((code << np.int64(bits)) | (rank - low))
    return np.lexsort((rank, code))


def _at_most(columns: list[np.ndarray], bound: list[int]) -> int:
    """How many of the sorted tuples are at most the bound."""
    lo, hi = 0, len(columns[0])
    for c, b in zip(columns, bound, strict=True):
        left = lo + int(np.searchsorted(c[lo:hi], b, "left"))
        hi, lo = lo + int(np.searchsorted(c[lo:hi], b, "right")), left
        if lo == hi:
            return lo
    return hi


class Queue:
    """A priority queue of tuples (words, rank, payload): push any, then pop all in order.

    What exceeds the budget is written to a file in sorted runs, which pop() merges."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.held, self.pending = budget, 0, []
        self.file, self.runs, self.width = None, [], 0

    def push(self, words: list[np.ndarray], rank: np.ndarray, payload: np.ndarray) -> None:
        if len(rank):
            self.pending.append((words, rank.astype(np.int64), payload.astype(np.int64)))
            self.width, self.held = max(self.width, len(words)), self.held + len(rank)
            if self.held >= self.budget:
                self._spill()

    def _sorted(self) -> list[np.ndarray]:
        words = [np.concatenate([p[0][k] if k < len(p[0]) else np.zeros(len(p[1]), np.int64) for p in self.pending]) for k in range(self.width)]
        rank, payload = (np.concatenate([p[i] for p in self.pending]) for i in (1, 2))
        order = _order(words, rank)
        self.pending, self.held = [], 0
        return [x[order] for x in (*words, rank, payload)]

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        columns = self._sorted()
        places = []
        for c in columns:
            places.append(self.file.tell())
            self.file.write(memoryview(np.ascontiguousarray(c)).cast("B"))
        self.runs.append([places, len(columns[0]), 0])

    def _read(self, run: list, n: int) -> list[np.ndarray]:
        places, total, at = run
        n = min(n, total - at)
        out = []
        for place in places:
            self.file.seek(place + 8 * at)
            out.append(np.frombuffer(self.file.read(8 * n), np.int64))
        run[2] = at + n
        if len(places) < self.width + 2:  # written before tuples were this wide
            out[-2:-2] = [np.zeros(n, np.int64)] * (self.width + 2 - len(places))
        return out

    def pop(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """Blocks of (words, rank, payload) in order."""
        if not self.runs:
            if self.pending:
                *words, rank, payload = self._sorted()
                yield words, rank, payload
            return
        if self.pending:
            self._spill()
        take = max(self.budget // len(self.runs), 1)
        ahead = [self._read(run, take) for run in self.runs]
        while True:
            ends = [[int(c[-1]) for c in a[:-1]] for a, run in zip(ahead, self.runs, strict=True) if len(a[0]) and run[2] < run[1]]
            bound = min(ends) if ends else None
            parts = []
            for i, a in enumerate(ahead):
                k = _at_most(a[:-1], bound) if bound is not None else len(a[0])
                if k:
                    parts.append([c[:k] for c in a])
                    ahead[i] = [c[k:] for c in a]
                if not len(ahead[i][0]) and self.runs[i][2] < self.runs[i][1]:
                    ahead[i] = self._read(self.runs[i], take)
            if not parts:
                return
            columns = [np.concatenate([p[i] for p in parts]) for i in range(self.width + 2)]
            order = _order(columns[: self.width], columns[self.width])
            *words, rank, payload = (c[order] for c in columns)
            yield words, rank, payload


class RangeMin:
    """Least of any range of an array of bytes, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray, store: Store):
        self.levels, n, step = [values], len(values), 1
        while 2 * step <= n:
            below = self.levels[-1]
            level = store.array(n - 2 * step + 1, np.uint8)
            for lo in range(0, len(level), BLOCK):
                hi = min(lo + BLOCK, len(level))
                level[lo:hi] = np.minimum(below[lo:hi], below[lo + step : hi + step])
            self.levels.append(level)
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the places first to last, both included."""
        size = last - first + 1
        out = np.empty(len(first), np.uint8)
        k = np.frexp(size.astype(np.float64))[1] - 1
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            x = self.levels[level]
            out[at] = np.minimum(x[first[at]], x[last[at] - (1 << int(level)) + 1])
        return out


class _Runs:
    """The runs of a block of whole strings, and what follows from them."""

    def __init__(self, text: np.ndarray, bits: int):
        short = np.int32 if bits < 31 and len(text) < 2**31 else np.int64
        self.bits = bits + _RUN_BITS  # of a column: a symbol, and its run so that order is kept
        self.fit = 63 // self.bits
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (text[1:] == 0)
        self.head = np.flatnonzero(new).astype(short)
        self.symbol = text[self.head].astype(short)
        self.end = np.append(self.head[1:], short(len(text)))
        self.small = self.symbol == 0
        self.small[:-1] |= self.symbol[:-1] < self.symbol[1:]
        star = self.symbol == 0
        star[1:] |= self.small[1:] & ~self.small[:-1]
        self.star = np.flatnonzero(star)
        self.segment = np.cumsum(star, dtype=short)  # the S* run that ends it; an S* run belongs to the next one
        column = self.column(self.symbol, self.end - self.head, self.small)
        self.packed = np.zeros(len(column), np.int64)
        for k in range(min(self.fit, len(column))):
            self.packed[: len(column) - k] |= column[k:] << np.int64(self.bits * (self.fit - 1 - k))

    def column(self, symbol: np.ndarray, run: np.ndarray, small: np.ndarray) -> np.ndarray:
        """A long L run is larger than a short one, a long S run smaller; L comes before S."""
        run = np.minimum(run, LONGEST_RUN)
        return (symbol.astype(np.int64) << _RUN_BITS) | np.where(small, 127 - run, run)

    def words(self, run: np.ndarray, count: np.ndarray, first: np.ndarray | None = None) -> list[np.ndarray]:
        """Columns of `count` runs from each run on, packed; first: in place of the first column."""
        out = []
        for k in range(0, int(count.max()) if len(count) else 1, self.fit):
            left = np.clip(count - k, 0, self.fit)
            keep = np.array([((1 << (self.bits * c)) - 1) << (self.bits * (self.fit - c)) for c in range(self.fit + 1)], np.int64)
            word = self.packed[np.minimum(run + k, len(self.packed) - 1)] & keep[left]
            if k == 0 and first is not None:
                top = np.int64(self.bits * (self.fit - 1))
                word = (word & ((np.int64(1) << top) - 1)) | (first << top)
            out.append(word)
        return out or [np.zeros(0, np.int64)]


def _differ(a: list[np.ndarray], b: list[np.ndarray], bits: int) -> np.ndarray:
    """Symbols that two different tuples of packed columns have in common before they differ."""
    fit = 63 // bits
    n = len(a[0])
    out, going = np.zeros(n, np.int64), np.ones(n, bool)
    for x, y in zip(a, b, strict=True):
        for k in range(fit):
            shift = np.int64(bits * (fit - 1 - k))
            mask = np.int64((1 << bits) - 1)
            p, q = (x >> shift) & mask, (y >> shift) & mask
            rp, rq = (np.where((v & _RUN) > LONGEST_RUN, 127 - (v & _RUN), v & _RUN) for v in (p, q))
            alike = (p >> _RUN_BITS) == (q >> _RUN_BITS)
            out += np.where(going & alike, np.minimum(rp, rq), 0)
            going &= p == q
            if not going.any():
                return np.minimum(out, MOST)
    return np.minimum(out, MOST)


def _prefixes(words: list[np.ndarray], last: list[int] | None, bits: int, same: np.ndarray) -> np.ndarray:
    """Common prefixes of sorted tuples with those before them where they aren't the same."""
    out = np.zeros(len(same), np.int64)
    at = np.flatnonzero(~same)
    if len(at) and at[0] == 0 and last is None:
        at = at[1:]
    before = [np.concatenate([[last[k] if last else 0], w[:-1]])[at] if len(w) else w for k, w in enumerate(words)]
    if len(at):
        out[at] = _differ([w[at] for w in words], before, bits)
    return out


def _same(words: list[np.ndarray], last: list[int] | None) -> np.ndarray:
    out = np.ones(len(words[0]), bool)
    for k, w in enumerate(words):
        out[1:] &= w[1:] == w[:-1]
        out[0] &= last is not None and int(w[0]) == (last[k] if k < len(last) else 0)
    return out


def _blocks(text: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Ranges of whole strings of about `budget` symbols."""
    out, lo, n = [], 0, len(text)
    while lo < n:
        hi = min(lo + budget, n)
        while hi < n:
            zero = np.flatnonzero(text[lo:hi] == 0)
            if len(zero):
                hi = lo + int(zero[-1]) + 1
                break
            hi = min(hi + budget, n)  # one string that is longer than a block
        out.append((lo, hi))
        lo = hi
    return out


def _by_symbol(text: np.ndarray, need: np.ndarray, blocks: list, store: Store) -> tuple[np.ndarray, np.ndarray]:
    queue, n = Queue(store.budget), 0
    for lo, hi in blocks:
        at = np.flatnonzero(need[lo:hi])
        queue.push([text[lo:hi][at].astype(np.int64)], at + lo, at + lo)
        n += len(at)
    order, common, k, last = store.array(n, np.int64), store.array(n, np.uint8), 0, None
    for words, _, place in queue.pop():
        order[k : k + len(place)] = place
        common[k : k + len(place)] = _same(words, last)
        k, last = k + len(place), [int(words[0][-1])]
    return order, common


def _induced(queue: Queue, n: int, bits: int, distance: int, common: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, first columns and common prefixes of a queue's tuples in order.

    A payload holds a position, and in its lower bits the symbols before what induced it;
    common: prefixes of the inducing suffixes by rank."""
    order, first, out = store.array(n, np.int64), store.array(n, np.int64), store.array(n, np.uint8)
    least = RangeMin(common, store)
    k, last, last_rank = 0, None, 0
    fit = 63 // bits
    for words, rank, payload in queue.pop():
        m = len(rank)
        same = _same(words, last)
        found = _prefixes(words, last, bits, same)
        at = np.flatnonzero(same)
        if len(at):
            before = np.concatenate([[last_rank], rank[:-1]])[at]
            # equal ranks: places of one run that is longer than what is told apart
            found[at] = np.where(before < rank[at], (payload[at] & np.int64((1 << distance) - 1)) + least.least(np.minimum(before + 1, rank[at]), rank[at]), MOST)
        order[k : k + m] = payload >> np.int64(distance)
        first[k : k + m] = words[0] >> np.int64(bits * (fit - 1))
        out[k : k + m] = np.minimum(found, MOST)
        k, last, last_rank = k + m, [int(w[-1]) for w in words], int(rank[-1])
    return order, first, out


#: Bits of a payload for the distance to the inducing suffix, which counts up to MOST only.
_DISTANCE = 7


def sort_suffixes(text: np.ndarray, need: np.ndarray, depth: int, budget: int = BUDGET, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions that `need` marks in the order of their first `depth` symbols at least,
    and how many symbols each shares with the one before (exact up to the depth).

    text: strings of positive symbols, each ended by a 0, which need doesn't mark."""
    if depth > LONGEST_RUN:
        raise ValueError(f"depths over {LONGEST_RUN} aren't supported")
    store = store or Store(budget)
    blocks = _blocks(text, min(store.budget, BLOCK))
    if depth <= 1 or not blocks:
        return _by_symbol(text, need, blocks, store)
    bits = max(int(max(int(text[lo:hi].max()) for lo, hi in blocks)).bit_length(), 1)
    # names of the substrings between S* runs
    queue, at, counts = Queue(store.budget), 0, []
    most = len(text) // 2 + sum(int((text[lo:hi] == 0).sum()) for lo, hi in blocks)  # of S* runs
    place, wanted = store.array(most, np.int64), store.array(most, bool)
    for lo, hi in blocks:
        r = _Runs(text[lo:hi], bits)
        m = len(r.star)
        counts.append(m)
        place[at : at + m] = r.head[r.star] + lo
        stop = np.append(r.star[1:], r.star[-1])
        ends = r.symbol[r.star] == 0
        count = np.where(ends, 1, np.minimum(stop - r.star + 1, depth + 1))
        queue.push(r.words(r.star, count), np.arange(at, at + m), np.arange(at, at + m))
        # a segment is wanted if a position from the S* run before it up to its own is
        sums = np.concatenate([[0], np.cumsum(need[lo:hi])])
        begin = np.concatenate([[0], r.head[r.star[:-1]]])
        wanted[at : at + m] = sums[r.head[r.star]] > sums[begin]
        at += m
    n, names = at, store.array(at, np.int64)
    place, wanted = place[:n], wanted[:n]
    new, sizes, last = 0, [], None
    for words, _, j in queue.pop():
        same = _same(words, last)
        apart = _prefixes(words, last, bits + _RUN_BITS, same)
        if last is None:
            same[0] = False
        names[j] = new + np.cumsum(~same) - 1
        sizes.append(apart[~same].astype(np.uint8))
        new, last = new + int((~same).sum()), [int(w[-1]) for w in words]
    between = store.array(new, np.uint8)  # common prefixes of a name and the one before
    k = 0
    for x in sizes:
        between[k : k + len(x)] = x
        k += len(x)
    # k names stand for 2k + 1 symbols at least; the name of the end is 0, as the recursion asks
    deep = depth // 2
    seeds, in_names = sort_suffixes(names, _not_ends(names, wanted, store), deep, budget, store)
    rank, common = store.array(n, np.int64), store.array(n, np.uint8)
    least = RangeMin(between, store)
    ends_first = int(sum(int(((names[lo : lo + store.block] == 0) & wanted[lo : lo + store.block]).sum()) for lo in range(0, n, store.block)))
    k = 0
    for lo in range(0, n, store.block):  # suffixes of an end alone come first; they are alike
        j = lo + np.flatnonzero((names[lo : lo + store.block] == 0) & wanted[lo : lo + store.block])
        rank[j] = np.arange(k, k + len(j))
        common[k : k + len(j)] = MOST
        k += len(j)
    if k:
        common[0] = 0
    before = -1
    for lo in range(0, len(seeds), store.block):
        j, v = seeds[lo : lo + store.block], in_names[lo : lo + store.block].astype(np.int64)
        rank[j] = np.arange(ends_first + lo, ends_first + lo + len(j))
        prev = np.concatenate([[before if before >= 0 else j[0]], j[:-1]])
        found = np.full(len(j), MOST)
        apart = np.flatnonzero(v < deep)
        a, b = j[apart] + v[apart], prev[apart] + v[apart]
        x, y = names[a], names[b]
        other = x != y
        got = np.full(len(apart), MOST)
        got[other] = place[a[other]] - place[j[apart][other]] + least.least(np.minimum(x, y)[other] + 1, np.maximum(x, y)[other])
        found[apart] = np.minimum(got, MOST)
        if before < 0:
            found[0] = 0
        common[ends_first + lo : ends_first + lo + len(j)] = found
        before = int(j[-1])
    # suffixes of type L, then of type S
    total = ends_first + len(seeds)
    large, size, at = Queue(store.budget), 0, 0
    for (lo, hi), m in zip(blocks, counts, strict=True):
        r, own = _Runs(text[lo:hi], bits), need[lo:hi]
        run, pos = _positions(r, ~r.small, own, lead=True)
        seg = r.segment[run]
        keep = wanted[at : at + m][seg]
        run, pos, seg = run[keep], pos[keep], seg[keep]
        stop = r.star[seg]
        words = r.words(run, np.minimum(stop - run + 1, depth + 1), r.column(r.symbol[run], r.end[run] - pos, r.small[run]))
        far = np.minimum(r.head[stop] - pos, 127)
        large.push(words, rank[at : at + m][seg], ((pos + lo) << _DISTANCE) | far)
        size, at = size + len(pos), at + m
    l_order, l_first, l_common = _induced(large, size, bits + _RUN_BITS, _DISTANCE, common[:total], store)
    where = store.array(len(text), np.int32 if len(text) < 2**31 else np.int64)
    for lo in range(0, size, store.block):
        some = l_order[lo : lo + store.block]
        where[some] = np.arange(lo, lo + len(some))
    small, s_size, at = Queue(store.budget), 0, 0
    for (lo, hi), m in zip(blocks, counts, strict=True):
        r, own = _Runs(text[lo:hi], bits), need[lo:hi]
        top = _tops(r)
        run, pos = _positions(r, r.small & (r.symbol > 0), own, lead=False)
        if len(run):
            stop = top[r.segment[run]]
            words = r.words(run, np.minimum(stop - run + 1, depth + 1), r.column(r.symbol[run], r.end[run] - pos, r.small[run]))
            far = np.minimum(r.head[stop] - pos, 127)
            small.push(words, where[r.head[stop] + lo], ((pos + lo) << _DISTANCE) | far)
            s_size += len(pos)
        at += m
    s_order, s_first, s_common = _induced(small, s_size, bits + _RUN_BITS, _DISTANCE, l_common, store)
    del where
    return _together(l_order, l_first, l_common, s_order, s_first, s_common, need, store)


def _not_ends(names: np.ndarray, wanted: np.ndarray, store: Store) -> np.ndarray:
    out = store.array(len(names), bool)
    for lo in range(0, len(names), store.block):
        out[lo : lo + store.block] = wanted[lo : lo + store.block] & (names[lo : lo + store.block] > 0)
    return out


def _tops(r: _Runs) -> np.ndarray:
    """The first L run of each segment (its own S* run where there is none)."""
    out = r.star.copy()
    lead = ~r.small
    lead[1:] &= r.small[:-1]
    at = np.flatnonzero(lead)
    out[r.segment[at]] = at
    return out


def _positions(r: _Runs, runs: np.ndarray, need: np.ndarray, lead: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs and positions within those runs that are needed, and with lead the first
    L run of each segment, which induces others."""
    mark = need.copy()
    if lead:
        at = np.flatnonzero(~r.small & np.concatenate([[True], r.small[:-1]]))
        mark[r.head[at]] = True
    at = np.flatnonzero(runs)
    size = r.end[at] - r.head[at]
    if int(size.max(initial=1)) == 1:
        run, pos = at, r.head[at]
    else:
        run = np.repeat(at, size)
        pos = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(r.head[at], size)
    keep = mark[pos]
    return run[keep], pos[keep]


def _together(l_order: np.ndarray, l_first: np.ndarray, l_common: np.ndarray, s_order: np.ndarray, s_first: np.ndarray, s_common: np.ndarray, need: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Merges the two types by symbol, L before S, and leaves out what isn't needed."""
    n = len(l_order) + len(s_order)
    order, common = store.array(n, np.int64), store.array(n, np.uint8)
    first = store.array(n, np.int64)
    for a_order, a_first, a_common, b_first, side in ((l_order, l_first, l_common, s_first, "left"), (s_order, s_first, s_common, l_first, "right")):
        for lo in range(0, len(a_order), store.block):
            col = a_first[lo : lo + store.block]
            # all of L with a symbol come before all of S with it
            bound = (col >> _RUN_BITS) << _RUN_BITS if side == "left" else ((col >> _RUN_BITS) << _RUN_BITS) | 127
            to = np.arange(lo, lo + len(col)) + np.searchsorted(b_first, bound, side)
            order[to], common[to], first[to] = a_order[lo : lo + len(col)], a_common[lo : lo + len(col)], col
    out, prefix, k, low = store.array(n, np.int64), store.array(n, np.uint8), 0, MOST
    last = None
    for lo in range(0, n, store.block):
        pos, col, own = order[lo : lo + store.block], first[lo : lo + store.block], common[lo : lo + store.block].astype(np.int64)
        before = np.concatenate([[col[0] if last is None else last], col[:-1]])
        kind = lambda v: (v & _RUN) > LONGEST_RUN
        run = lambda v: np.where(kind(v), 127 - (v & _RUN), v & _RUN)
        alike = (col >> _RUN_BITS) == (before >> _RUN_BITS)
        own = np.where(alike & (kind(col) == kind(before)), own, np.where(alike, np.minimum(run(col), run(before)), 0))
        if last is None:
            own[0] = 0
        last = int(col[-1])
        keep = np.flatnonzero(need[pos])
        if len(keep):
            least = np.minimum.reduceat(np.concatenate([[low], own])[: keep[-1] + 2], np.concatenate([[0], keep[:-1] + 2]))
            out[k : k + len(keep)], prefix[k : k + len(keep)] = pos[keep], least
            low = int(own[keep[-1] + 1 :].min(initial=MOST))
            k += len(keep)
        else:
            low = min(low, int(own.min(initial=MOST)))
    return out[:k], prefix[:k]
