"""Induced suffix sorting with common-prefix values, for one shard of text inside a task.

The suffixes that start a rise after a fall (the seeds, a third of all or fewer) are named by the order of the text
between them, and sorted by recursion on the names.  From their order all others follow in two scans: popping suffixes in
order pushes the suffix one place to the left into a priority queue.  The queue's key is the first
symbol and then the order of arrival, so it is a first-in first-out list per symbol, whose blocks go to disk when they
exceed the memory given.  Entries are (position, common prefix with the entry before); the common prefix of two pushed
suffixes is one more than the least value among the pops between their parents.

All is sorted up to ``depth`` symbols and prefixes count up to ``depth``, which is all that repeats of that length need.  In
memory are the text, its types and blocks of the queue; entries are numpy blocks, so no loop runs per suffix.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np

from seqpool.llm import textarrays as T

BLOCK = 1 << 18  # entries that a step handles at once
MEMORY_ENTRIES = 1 << 24  # queue entries (10 bytes each) held in memory
RECURSION_SYMBOLS = 1 << 12  # alphabets above this are sorted by doubling, not by induction
NONE = np.iinfo(np.uint16).max


class DiskQueue:
    """Entries per symbol, in order of arrival; the blocks of later symbols go to files when memory runs out."""

    def __init__(self, symbols: int, fs=None, folder: str | None = None, memory: int = MEMORY_ENTRIES):
        self.blocks: list[deque] = [deque() for _ in range(symbols)]
        self.fs, self.folder, self.memory = fs, folder, memory
        self.held, self.files = 0, []

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.blocks[symbol].append((positions, prefixes))
        self.held += len(positions)
        if self.held > self.memory and self.fs is not None:
            self._spill(symbol)

    def _spill(self, busy: int) -> None:
        sizes = [sum(len(b[0]) for b in q if not isinstance(b[0], str)) for q in self.blocks]
        for symbol in np.argsort(sizes)[::-1]:
            if self.held <= self.memory // 2:
                return
            q = self.blocks[symbol]
            plain = [b for b in q if not isinstance(b[0], str)]
            if not plain or (symbol == busy and len(q) == 1):
                continue
            name = f"{self.folder}/{uuid.uuid4().hex}.queue"
            with self.fs.open_output_stream(name, compression=None) as out:
                for i, b in enumerate(q):
                    if not isinstance(b[0], str):
                        at = out.tell()
                        out.write(np.ascontiguousarray(b[0]).tobytes())
                        out.write(np.ascontiguousarray(b[1]).tobytes())
                        q[i] = (name, at, len(b[0]), b[0].dtype)
                        self.held -= len(b[0])
            self.files.append(name)

    def _load(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(block[0], str):
            self.held -= len(block[0])
            return block
        name, at, size, kind = block
        with self.fs.open_input_file(name) as f:
            raw = f.read_at(size * (kind.itemsize + 2), at)
        return np.frombuffer(raw, dtype=kind, count=size), np.frombuffer(raw, dtype=np.uint16, offset=size * kind.itemsize)

    def pop(self, symbol: int, limit: int = BLOCK):
        """The next entries of a symbol, at most about ``limit``; None if there are none."""
        q = self.blocks[symbol]
        taken, n = [], 0
        while q and n < limit:
            taken.append(self._load(q.popleft()))
            n += len(taken[-1][0])
        if len(taken) < 2:
            return taken[0] if taken else None
        return np.concatenate([b[0] for b in taken]), np.concatenate([b[1] for b in taken])

    def pop_last(self, symbol: int):
        """The block that came last; None if there is none."""
        return self._load(self.blocks[symbol].pop()) if self.blocks[symbol] else None

    def close(self) -> None:
        for name in self.files:
            self.fs.delete_file(name)


class _RangeMin:
    """Least value of ranges of one block."""

    def __init__(self, x: np.ndarray):
        self.tables = [x]
        width = 1
        while 2 * width <= len(x):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over [lo, hi), never empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=self.tables[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.tables[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << int(k))])
        return out


class _Scan:
    """One scan: pops in order push their left neighbours of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: DiskQueue, symbols: int, depth: int, prefixes: bool):
        self.text, self.wanted, self.queue, self.depth, self.prefixes = text, wanted, queue, depth, prefixes
        self.since = np.full(symbols, NONE, dtype=np.uint16)  # least value since the last push of a symbol
        self.pushed = np.zeros(symbols, dtype=bool)

    def feed(self, positions: np.ndarray, values: np.ndarray) -> None:
        """Take the next pops and the common prefix of each with the one before it."""
        source = np.flatnonzero(positions > 0)
        left = positions[source] - 1
        good = self.wanted[left]
        source, left = source[good], left[good]
        symbol = self.text[left]
        order = np.argsort(symbol, kind="stable")
        source, left, symbol = source[order], left[order], symbol[order]
        first = np.ones(len(symbol), dtype=bool)
        first[1:] = symbol[1:] != symbol[:-1]
        starts = np.flatnonzero(first)
        if not self.prefixes:
            found = np.zeros(len(left), dtype=np.uint16)
        else:
            found = np.empty(len(left), dtype=np.uint16)
            if len(left):
                least = _RangeMin(values)
                again = np.flatnonzero(~first)
                found[again] = least(source[again - 1] + 1, source[again] + 1)
                heads = symbol[starts]
                whole = least(np.zeros(len(starts), dtype=np.int64), source[starts] + 1)
                found[starts] = np.where(self.pushed[heads], np.minimum(whole, self.since[heads]), 0)
                np.minimum(found, self.depth - 1, out=found)
                found += 1
                found[starts[~self.pushed[heads]]] = 0
            if len(values):
                np.minimum(self.since, values.min(), out=self.since)
            if len(left):
                ends = np.append(starts[1:], len(symbol)) - 1
                after = source[ends] + 1
                rest = np.full(len(ends), NONE, dtype=np.uint16)
                more = after < len(values)
                if more.any():
                    rest[more] = least(after[more], np.full(int(more.sum()), len(values)))
                self.since[symbol[ends]] = rest
                self.pushed[heads] = True
        for a, b in zip(starts, [*starts[1:], len(symbol)], strict=False):
            self.queue.push(int(symbol[a]), left[a:b], found[a:b])


def suffix_types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rises, run): whether a suffix is smaller than the next one, and how often its first symbol repeats there."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    stop = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    rises = np.ones(n, dtype=bool)  # the end sign counts as rising
    inner = stop < n - 1
    rises[inner] = text[stop[inner]] < text[stop[inner] + 1]
    return rises, (stop - np.arange(n) + 1)


def _induce(text, rises, run, seeds, seed_values, symbols, depth, prefixes, emit, space) -> None:
    """Emit all suffixes from the largest to the smallest, block by block, with the common prefix with the one before.

    ``seeds``: positions in ascending order (of their first symbol at least), ``seed_values``: common prefixes."""
    fs, folder, memory = space
    runs = np.minimum(run, depth)
    rising, falling = DiskQueue(symbols, fs, folder, memory), DiskQueue(symbols, fs, folder, memory)
    kept = DiskQueue(symbols, fs, folder, memory)  # falling suffixes in ascending order
    try:
        scan = _Scan(text, ~rises, falling, symbols, depth, prefixes)
        edges = np.searchsorted(text[seeds], np.arange(symbols + 1))
        for c in range(symbols):
            last = None
            while (block := falling.pop(c)) is not None:
                kept.push(c, *block)
                scan.feed(*block)
                last = int(block[0][-1])
            for lo in range(edges[c], edges[c + 1], BLOCK):
                positions, values = seeds[lo: min(lo + BLOCK, edges[c + 1])], seed_values[lo: min(lo + BLOCK, edges[c + 1])].copy()
                if lo == edges[c]:
                    values[0] = 0 if last is None else min(runs[last], runs[positions[0]])
                scan.feed(positions, values)
        scan = _Scan(text, rises, rising, symbols, depth, prefixes)
        end = len(text) - 1
        rising.push(int(text[end]), np.array([end], dtype=seeds.dtype), np.zeros(1, dtype=np.uint16))
        for c in range(symbols - 1, -1, -1):
            last = None
            while (block := rising.pop(c)) is not None:
                scan.feed(*block)
                emit(*block)
                last = int(block[0][-1])
            # the falling ones of this symbol, from the largest: their value is that with the next larger one
            carried = None
            while (block := kept.pop_last(c)) is not None:
                positions, values = block[0][::-1], block[1]
                down = np.empty(len(values), dtype=np.uint16)
                down[1:] = values[::-1][:-1]
                down[0] = carried if carried is not None else (0 if last is None else min(runs[last], runs[positions[0]]))
                carried = values[0]
                scan.feed(positions, down)
                emit(positions, down)
    finally:
        for q in (rising, falling, kept):
            q.close()


def double_sort(names: np.ndarray, reach: int) -> np.ndarray:
    """Suffix order of an integer text up to ``reach`` symbols, by doubling; only what is not yet told apart is sorted."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    heads = np.ones(n, dtype=bool)
    heads[1:] = names[order][1:] != names[order][:-1]
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 1
    while h < reach:
        alone = heads & np.append(heads[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[slots] = at
        split = np.ones(len(at), dtype=bool)
        split[1:] = key[1:] != key[:-1]
        heads[slots] |= split
        rank[at] = np.maximum.accumulate(np.where(split, slots, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a[i] and b[i], up to ``depth``, by bisection on hashes."""
    n = len(text)
    value = T.mix(text.astype(np.uint64) + np.uint64(1))
    powers = T._powers(n + 1, T.BASE)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value * powers[:n], out=sums[1:])
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    shift = powers[hi - lo]
    low = np.zeros(len(a), dtype=np.int64)
    high = np.minimum(depth, n - hi)
    open_ = np.flatnonzero(high > 0)
    probe = 8  # the first tries grow, the later ones halve
    while len(open_):
        x, y, u, v = lo[open_], hi[open_], low[open_], high[open_]
        mid = np.clip(u + probe, u + 1, v) if probe < depth else (u + v + 1) // 2
        same = (sums[x + mid] - sums[x]) * shift[open_] == sums[y + mid] - sums[y]
        low[open_] = np.where(same, mid, u)
        high[open_] = np.where(same, v, mid - 1)
        open_ = open_[low[open_] < high[open_]]
        probe *= 4
    return low.astype(np.uint16)


def sorted_suffixes(text: np.ndarray, symbols: int, depth: int, emit, space=(None, None, MEMORY_ENTRIES), prefixes: bool = True) -> None:
    """Emit (positions, common prefixes with the one before) of all suffixes, from the largest to the smallest.

    ``text``: integers below ``symbols``, ending in a 0 that stands nowhere else."""
    rises, run = suffix_types(text)
    seeds = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    if not len(seeds) or seeds[-1] != len(text) - 1:
        seeds = np.append(seeds, len(text) - 1)
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    if len(seeds) > 1:
        is_seed = np.zeros(len(text), dtype=bool)
        is_seed[seeds] = True
        found: list[np.ndarray] = []
        _induce(text, rises, run, by_symbol, np.zeros(len(seeds), dtype=np.uint16), symbols, depth, False,
                lambda p, _: found.append(p[is_seed[p]]), space)
        ranked = np.concatenate(found)[::-1]  # by the text up to the next seed
        names = _names(text, seeds, ranked)
        by_symbol = seeds[_seed_order(names, depth, space)]
    values = np.zeros(len(by_symbol), dtype=np.uint16)
    if prefixes:
        values[1:] = common_prefixes(text, by_symbol[:-1], by_symbol[1:], depth)
    _induce(text, rises, run, by_symbol, values, symbols, depth, prefixes, emit, space)


def _names(text: np.ndarray, seeds: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """The rank of the text from each seed to the next (both included), in text order; equal pieces have equal names."""
    ends = np.minimum(np.append(seeds[1:], len(text) - 1) + 1, len(text))
    digest = T.span_hashes(T.mix(text.astype(np.uint64) + np.uint64(1)), seeds, ends)
    index = np.searchsorted(seeds, ranked)
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = digest[index][1:] != digest[index][:-1]
    names = np.empty(len(seeds), dtype=np.int64)
    names[index] = np.cumsum(new) - 1
    return names


def _seed_order(names: np.ndarray, depth: int, space) -> np.ndarray:
    """Suffix order of the names: by recursion while the alphabet is small, else by doubling."""
    symbols = int(names.max()) + 1
    if symbols == len(names):
        return np.argsort(names)
    if symbols > RECURSION_SYMBOLS or len(names) < 64:
        return double_sort(names, depth // 2 + 1)  # a name covers two symbols at least
    order: list[np.ndarray] = []
    sorted_suffixes(names, symbols, depth // 2 + 1, lambda p, _: order.append(p), space, prefixes=False)
    return np.concatenate(order)[::-1]
