"""External induced sorting of all suffixes of one text, with the common prefix
of neighbours, after the eSAIS scheme (Bingmann, Fischer, Osipov, 2013).

A text is an array of symbols whose last one is 0 and occurs nowhere else. A
suffix is L if it is larger than the one behind it, else S; an LMS suffix is an
S behind an L. The steps:

1. The text is cut at its LMS positions, and every ``width`` symbols where
   these are further apart. The pieces (with the symbol behind them, symbols
   with their types) are sorted as tuples and named by their rank. No piece is
   the beginning of another: types tell an LMS cut from a cut by length.
2. The names in text order are a shorter text. Unless all differ, its suffixes
   are sorted by the same steps: the recursion. It ends with names that fit a
   quarter of ``memory``: these are sorted in place by prefix doubling.
3. The sorted LMS suffixes induce the L suffixes from small to large, and
   these induce the S suffixes from large to small. A priority queue holds
   tuples (symbol, position, common prefix) of suffixes found by the one
   behind them; each is taken out when the scan gets to it, and induces the
   one before it.

The queue is monotone: what is pushed comes later in the scan, and pushes for
one symbol arrive in the order in which they leave. So it is a row of buckets
of symbol ranges, each first in, first out; buckets ahead of the scan go to
disk once ``memory`` tuples are held. Positions, pieces and names are arrays
in files too, where they are longer than that: what the process holds does not
grow with the text.
Files have no name any more once open, so nothing is left behind whatever
happens to the task; nothing else ever reads them.

Suffixes leave the queue a whole batch at a time: as many as come before the
first place where the batch itself puts a new one. All work on a batch is
vector operations.

Common prefixes count symbols up to ``limit``. LMS neighbours are compared
once; from there on the values are carried by the tuples: two suffixes that
follow each other for one symbol have one more symbol in common than the
least value scanned between those that induced them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 1 << 22
#: Tuples handled at once.
BATCH = 1 << 18
#: Symbols of a piece; 7 of 9 bits (value and type) fill one key of a byte text.
BYTE_WIDTH, NAME_WIDTH = 6, 4


class Disk:
    """Files without names in Spark's local folder, for what is longer than
    ``memory``."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        if self.folder and not os.path.isdir(self.folder):
            self.folder = None

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, dtype)
        f = tempfile.TemporaryFile(dir=self.folder)
        f.truncate(max(1, n) * np.dtype(dtype).itemsize)
        return np.asarray(np.memmap(f, dtype, "r+", shape=(max(1, n),))[:n])

    def log(self) -> Log:
        return Log(self)


class Log:
    """An append-only file of arrays."""

    def __init__(self, disk: Disk):
        self.file, self.size = tempfile.TemporaryFile(dir=disk.folder), 0

    def append(self, x: np.ndarray) -> tuple[int, int, np.dtype]:
        at = self.size
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(x).tobytes())
        self.size += x.nbytes
        return at, len(x), x.dtype

    def read(self, where: tuple[int, int, np.dtype]) -> np.ndarray:
        at, n, dtype = where
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype)


class Sorter:
    """External sort of tuples by all columns but the last: sorted runs on
    disk, merged block by block."""

    def __init__(self, disk: Disk, memory: int):
        self.log, self.memory = disk.log(), memory
        self.held, self.n, self.runs = [], 0, []

    def push(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= self.memory:
            self._spill()

    @staticmethod
    def _ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
        keys = columns[:-1]
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        return [c[order] for c in columns]

    def _spill(self) -> None:
        if not self.n:
            return
        columns = self._ordered([np.concatenate(c) for c in zip(*self.held, strict=True)])
        step = max(1, self.memory // 8)
        self.runs.append([[self.log.append(c[i:i + step]) for c in columns] for i in range(0, self.n, step)])
        self.held, self.n = [], 0

    def blocks(self) -> Iterator[list[np.ndarray]]:
        if not self.runs:
            if self.n:
                yield self._ordered([np.concatenate(c) for c in zip(*self.held, strict=True)])
            return
        self._spill()
        runs = [iter(r) for r in self.runs]
        heads: list = [None] * len(runs)
        while True:
            for k, run in enumerate(runs):
                if heads[k] is None or not len(heads[k][0]):
                    nxt = next(run, None)
                    heads[k] = None if nxt is None else [self.log.read(w) for w in nxt]
            live = [k for k, h in enumerate(heads) if h is not None]
            if not live:
                return
            # all up to the least of the heads' last tuples is here
            bound = min(tuple(int(c[-1]) for c in heads[k][:-1]) for k in live)
            out = []
            for k in live:
                cut = _upper(heads[k][:-1], bound)
                out.append([c[:cut] for c in heads[k]])
                heads[k] = [c[cut:] for c in heads[k]]
            yield self._ordered([np.concatenate(c) for c in zip(*out, strict=True)])


def _upper(keys: list[np.ndarray], bound: tuple) -> int:
    """How many of the sorted tuples are at most ``bound``."""
    lo, hi = 0, len(keys[0])
    for key, b in zip(keys, bound, strict=True):
        v = key.dtype.type(b)
        a = lo + int(np.searchsorted(key[lo:hi], v, "left"))
        lo, hi = a, lo + int(np.searchsorted(key[lo:hi], v, "right"))
    return hi


class Queue:
    """The monotone priority queue: one first-in-first-out bucket for each
    symbol range, ``edges[b] <= symbol < edges[b + 1]``."""

    def __init__(self, edges: np.ndarray, disk: Disk, memory: int, kinds: list):
        self.edges, self.memory, self.log, self.kinds = edges, memory, disk.log(), kinds
        self.held: dict[int, list] = {}
        self.spilt: dict[int, list] = {}
        self.n = 0

    def push(self, symbols: np.ndarray, *rest: np.ndarray) -> None:
        if not len(symbols):
            return
        b = np.searchsorted(self.edges, symbols, "right") - 1
        order = np.argsort(b.astype(np.uint16) if len(self.edges) < 60_000 else b, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(b[order])) + 1, [len(b)]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[i:j]
            self.held.setdefault(int(b[at[0]]), []).append((symbols[at], *[c[at] for c in rest]))
        self.n += len(symbols)
        if self.n > self.memory:
            for k, parts in self.held.items():
                self.spilt.setdefault(k, []).append([self.log.append(np.concatenate(c).astype(t))
                                                     for c, t in zip(zip(*parts, strict=True), self.kinds, strict=True)])
            self.held, self.n = {}, 0

    def take(self, b: int):
        """The bucket's oldest tuples, None if it is empty."""
        if self.spilt.get(b):
            symbols, pos, shared = (self.log.read(w) for w in self.spilt[b].pop(0))
            return [symbols.astype(np.int64), pos.astype(np.int64), shared]
        parts = self.held.pop(b, None)
        if parts is None:
            return None
        self.n -= sum(len(p[0]) for p in parts)
        return [np.concatenate(c) for c in zip(*parts, strict=True)]


class Seeds:
    """Tuples in scan order, read by symbol ranges."""

    def __init__(self, blocks: Iterator):
        self.blocks, self.rest = blocks, None

    def until(self, symbol: int) -> Iterator[list[np.ndarray]]:
        while True:
            if self.rest is None or not len(self.rest[0]):
                self.rest = next(self.blocks, None)
                if self.rest is None:
                    return
            cut = int(np.searchsorted(self.rest[0], symbol, "left"))
            if cut:
                yield [c[:cut] for c in self.rest]
            self.rest = [c[cut:] for c in self.rest]
            if len(self.rest[0]):
                return


class Level:
    """One text of the recursion, with the edges of its symbol ranges.
    ``padded`` is a byte text with 8 more than ``limit`` bytes behind its end, given
    where common prefixes are asked for."""

    def __init__(self, text: np.ndarray, edges: np.ndarray, disk: Disk, memory: int, width: int, limit: int = 0,
                 padded: np.ndarray | None = None):
        self.text, self.disk, self.memory, self.limit, self.width = text, disk, memory, limit, width
        self.n, self.top = len(text), int(edges[-1])
        self.edges, self.step = edges, min(memory, BATCH)
        self.place = np.int32 if self.n < 1 << 31 else np.int64
        self.kinds = [np.uint16 if self.top <= 1 << 16 else np.uint32, self.place, np.uint8]
        if limit:  # eight bytes from any place on
            self.words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        self.small = self._types()

    def _chunks(self, backwards: bool = False) -> Iterator[tuple[int, int]]:
        starts = range(0, self.n, self.step)
        for a in reversed(starts) if backwards else starts:
            yield a, min(self.n, a + self.step)

    def _types(self) -> np.ndarray:
        """1 for S suffixes."""
        out = self.disk.array(self.n, np.uint8)
        nxt, kind = 0, 1  # the symbol behind the chunk and its type
        for a, b in self._chunks(backwards=True):
            t = np.asarray(self.text[a:b]).astype(np.int64)
            step = np.sign(np.diff(t, append=nxt))
            if b == self.n:
                step[-1] = 1  # the last symbol is S
            at = np.where(step != 0, np.arange(len(t)), len(t))
            at = np.minimum.accumulate(at[::-1])[::-1]
            kinds = np.append(step > 0, bool(kind))[at]
            out[a:b] = kinds
            nxt, kind = int(t[0]), int(kinds[0])
        return out

    def _is_lms(self, pos: np.ndarray) -> np.ndarray:
        return (pos > 0) & (self.small[pos] == 1) & (self.small[pos - 1] == 0)

    # ---------------------------------------------------- pieces and names

    def _samples(self) -> np.ndarray:
        """Where pieces begin, ascending; the last is the end symbol."""
        parts, log, last = [], self.disk.log(), -1
        n = 0
        for a, b in self._chunks():
            pos = np.arange(a, b)
            lms = pos[self._is_lms(pos)]
            if not len(lms):
                continue
            ends = lms
            starts = np.concatenate([[last], lms[:-1]])
            if last < 0:
                starts, ends = starts[1:], ends[1:]
            more = np.maximum(0, (ends - starts - 1) // self.width)
            k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
            got = np.sort(np.concatenate([lms, np.repeat(starts, more) + k * self.width]))
            parts.append(log.append(got.astype(self.place)))
            n += len(got)
            last = int(lms[-1])
        out, i = self.disk.array(n, self.place), 0
        for w in parts:
            out[i:i + w[1]] = log.read(w)
            i += w[1]
        return out

    def _keys(self, pos: np.ndarray, nxt: np.ndarray) -> list[np.ndarray]:
        bits = max(2, (self.top - 1).bit_length()) + 1
        per = 64 // bits
        out = []
        for i in range(self.width + 1):
            at = np.minimum(pos + i, self.n - 1)
            s = (self.text[at].astype(np.uint64) << np.uint64(1)) | self.small[at]
            s[pos + i > nxt] = 0
            if i % per == 0:
                out.append(s)
            else:
                out[-1] = (out[-1] << np.uint64(bits)) | s
        return out

    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """The samples, and their numbers in the order of their suffixes."""
        samples = self._samples()
        m = len(samples)
        sorter = Sorter(self.disk, self.memory)
        for a in range(0, m, self.step):
            b = min(m, a + self.step)
            pos = samples[a:b].astype(np.int64)
            nxt = samples[a + 1:b + 1].astype(np.int64)
            nxt = np.append(nxt, self.n - 1) if b == m else nxt
            sorter.push(*self._keys(pos, nxt), np.arange(a, b, dtype=self.place))
        names, order = self.disk.array(m, np.uint32), self.disk.array(m, self.place)
        done, name, before = 0, -1, None
        edges, load, room = [0], 0, _room(m, self.memory)
        for block in sorter.blocks():
            keys, at = block[:-1], block[-1]
            new = np.zeros(len(at), bool)
            for c in keys:
                new[1:] |= c[1:] != c[:-1]
            new[0] = before is None or any(int(c[0]) != v for c, v in zip(keys, before, strict=True))
            ids = name + np.cumsum(new)
            names[at] = ids
            order[done:done + len(at)] = at
            done, name, before = done + len(at), int(ids[-1]), [int(c[-1]) for c in keys]
            # bucket edges of the next level, from how often each name occurs
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(at)))
            if not new[0]:
                load += int(starts[0]) if len(starts) else len(at)
            for k, c in zip(ids[starts].tolist(), counts.tolist(), strict=True):
                if load and load + c > room:
                    edges.append(k)
                    load = 0
                load += c
        if name + 1 < m and m <= self.memory // 4:
            double_prefixes(names, order)
        elif name + 1 < m:
            edges = np.unique(np.append(np.array(edges, np.int64), name + 1))
            deeper = Level(names, edges, self.disk, self.memory, NAME_WIDTH)
            end = m
            for pos, _ in deeper.suffixes():
                order[end - len(pos):end] = pos[::-1]
                end -= len(pos)
            order[0] = m - 1
        return samples, order

    # ------------------------------------------------------- induction

    def _prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, up to the limit."""
        words, out = self.words, np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for i in range(0, self.limit, 8):
            x = words[a[live] + i] ^ words[b[live] + i]
            same = x == 0
            low = x[~same]
            out[live[~same]] = i + (np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3)
            out[live[same]] = i + 8
            live = live[same]
            if not len(live):
                break
        return np.minimum(out, self.limit)

    def _scan(self, seeds: Seeds, kind: int, flip: bool) -> Iterator[tuple]:
        """(symbol, position, common prefix, is seed) of all scanned suffixes,
        in batches. ``kind`` is the type that is induced; ``flip`` scans from
        large to small, with symbols counted from the top."""
        top = self.top
        edges = (top - self.edges)[::-1].copy() if flip else self.edges
        queue = Queue(edges, self.disk, self.memory, self.kinds)
        carry = np.zeros(top + 1, np.int16) if self.limit else None
        known = np.zeros(top + 1, bool) if self.limit else None
        last = (-1, -1, True)

        def before(pos: np.ndarray):
            """What the suffixes induce: (which of them, symbols, positions)."""
            at = np.flatnonzero(pos > 0)
            p = pos[at] - 1
            mine = self.small[p] == kind
            at, p = at[mine], p[mine]
            s = self.text[p].astype(np.int64)
            return at, (top - 1 - s if flip else s), p

        def carried(at: np.ndarray, symbols: np.ndarray, shared: np.ndarray) -> np.ndarray:
            """Common prefixes of the induced suffixes."""
            if not len(shared):
                return np.zeros(0, np.uint8)
            m = len(shared)
            out = np.zeros(len(at), np.int16)
            if len(at):
                order = np.argsort(symbols.astype(np.uint16), kind="stable")
                s, i = symbols[order], at[order]
                first = np.append(True, s[1:] != s[:-1])
                begin = np.minimum.accumulate(shared)
                value = np.minimum(carry[s], begin[i]).astype(np.int16) + 1
                value[first & ~known[s]] = 0
                later = np.flatnonzero(~first)
                if len(later):  # least of shared[lo:hi + 1] by a sparse table
                    lo, hi = i[later - 1] + 1, i[later]
                    size = hi - lo + 1
                    level = np.int64(np.log2(size))
                    table, low = shared, np.empty(len(later), shared.dtype)
                    for k in range(int(level.max()) + 1):
                        if k:
                            half = 1 << (k - 1)
                            table = np.minimum(table[:-half], table[half:])
                        now = level == k
                        low[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << k) + 1])
                    value[later] = low.astype(np.int16) + 1
                out[order] = np.minimum(value, self.limit)
                known[s] = True
            np.minimum(carry, np.int16(shared.min()), out=carry)
            if len(at):
                ends = np.append(s[1:] != s[:-1], True)
                rest = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.uint8(255))
                carry[s[ends]] = rest[i[ends] + 1]
            return out.astype(np.uint8)

        def visit(symbols, pos, shared, seed):
            """Fix the common prefix where seeds begin behind queued suffixes
            of their symbol."""
            nonlocal last
            if self.limit:
                s = np.append(last[0], symbols)
                was = np.append(last[2], seed)
                edge = np.flatnonzero(~was[:-1] & was[1:] & (s[:-1] == s[1:]))
                if len(edge):
                    p = np.append(last[1], pos)
                    shared = shared.copy()
                    shared[edge] = self._prefix(p[edge], p[edge + 1])
            last = (int(symbols[-1]), int(pos[-1]), bool(seed[-1]))
            return symbols, pos, shared, seed

        def alone(symbols, pos, shared, seed: bool):
            batch = visit(symbols, pos, shared, np.full(len(pos), seed))
            at, s, p = before(pos)
            queue.push(s, p, carried(at, s, batch[2]) if self.limit else np.zeros(len(p), np.uint8))
            return batch

        step = self.step
        for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if hi - lo == 1:  # one symbol: in the order of arrival, then the seeds
                while (got := queue.take(b)) is not None:
                    for i in range(0, len(got[0]), step):
                        yield alone(*[c[i:i + step] for c in got], False)
                for got in seeds.until(hi):
                    for i in range(0, len(got[0]), step):
                        yield alone(*[c[i:i + step] for c in got], True)
                continue
            parts = []
            while (got := queue.take(b)) is not None:
                parts.append((*got, np.zeros(len(got[0]), bool)))
            parts += [(*got, np.ones(len(got[0]), bool)) for got in seeds.until(hi)]
            if not parts:
                continue
            symbols, pos, shared, seed = (np.concatenate(c) for c in zip(*parts, strict=True))
            place = 2 * symbols + seed
            order = np.argsort(place, kind="stable")
            place, pos, shared = place[order], pos[order], shared[order]
            at, window = 0, 1024
            while at < len(pos):
                end = min(len(pos), at + window)
                who, s, p = before(pos[at:end])
                near = np.flatnonzero(s < hi)
                stop = end
                if len(near):
                    goes = np.searchsorted(place, 2 * s[near], "right")
                    least = np.minimum.accumulate(goes)
                    ok = np.append(True, who[near][1:] + at < least[:-1])
                    use = len(ok) if ok.all() else int(np.argmin(ok))
                    stop = min(end, int(least[use - 1]))
                window = min(1 << 16, max(256, 2 * (stop - at)))
                seeded = (place[at:stop] & 1).astype(bool)
                batch = visit(place[at:stop] >> 1, pos[at:stop], shared[at:stop], seeded)
                take = who < stop - at
                who, s, p = who[take], s[take], p[take]
                c = carried(who, s, batch[2]) if self.limit else np.zeros(len(p), np.uint8)
                yield batch
                far = s >= hi
                queue.push(s[far], p[far], c[far])
                if not far.all():
                    near = np.flatnonzero(~far)
                    near = near[np.argsort(s[near], kind="stable")]
                    goes = np.searchsorted(place, 2 * s[near], "right")
                    # left of them all is done: keep what is still to come
                    place = np.insert(place[stop:], goes - stop, 2 * s[near])
                    pos = np.insert(pos[stop:], goes - stop, p[near])
                    shared = np.insert(shared[stop:], goes - stop, c[near])
                    at = 0
                else:
                    at = stop

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the suffix before) of all suffixes
        but the end symbol's, from large to small, in batches."""
        if self.n < 2:
            return
        samples, order = self._order()

        def lms() -> Iterator[list[np.ndarray]]:
            before = None
            for a in range(0, len(order), self.step):
                pos = samples[order[a:a + self.step]].astype(np.int64)
                pos = pos[self._is_lms(pos)]
                if not len(pos):
                    continue
                shared = np.zeros(len(pos), np.uint8)
                if self.limit:
                    prior = np.append(pos[0] if before is None else before, pos[:-1])
                    shared = self._prefix(prior, pos).astype(np.uint8)
                    if before is None:
                        shared[0] = 0
                    before = pos[-1]
                yield [self.text[pos].astype(np.int64), pos, shared]

        found, parts = self.disk.log(), []
        for _, pos, shared, seed in self._scan(Seeds(lms()), 0, False):
            large = ~seed
            if large.any():
                parts.append([found.append(pos[large].astype(self.place)), found.append(shared[large])])
        del samples, order

        def downwards() -> Iterator[list[np.ndarray]]:
            above = np.uint8(0)
            while parts:
                pos, shared = (found.read(w)[::-1] for w in parts.pop())
                pos = pos.astype(np.int64)
                yield [self.top - 1 - self.text[pos].astype(np.int64), pos, np.append(above, shared[:-1])]
                above = shared[-1]

        for _, pos, shared, _ in self._scan(Seeds(downwards()), 1, True):
            yield pos, shared


def double_prefixes(names: np.ndarray, order: np.ndarray) -> None:
    """Bring ``order``, the positions sorted by name, into the order of the
    suffixes. Each round sorts those that share ``width`` names by the rank of
    what follows; the last name occurs once, so none of them reaches the end."""
    m, width = len(order), 1
    rank, live, key = np.empty(m, np.int64), np.arange(m), names[order].astype(np.int64)
    while len(live):
        new = np.append(True, key[1:] != key[:-1])
        rank[order[live]] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[~(new & np.append(new[1:], True))]
        pos = order[live].astype(np.int64)
        if not len(pos):
            return
        key = rank[pos] * m + rank[pos + width]
        by = np.argsort(key)
        order[live], key, width = pos[by], key[by], 2 * width


def _room(n: int, memory: int) -> int:
    """Tuples of a bucket; a symbol that occurs more often has its own."""
    return max(1, min(memory // 4, max(256, n // 64)))


def sorted_suffixes(padded: np.ndarray, limit: int, disk: Disk, memory: int = MEMORY) -> Iterator[tuple]:
    """(positions, common prefixes up to ``limit``, 254 at most) of the
    suffixes of a byte text, from large to small, without the end symbol's.
    The text is ``padded`` without its last ``limit`` + 8 bytes; its last
    byte must be its only 0."""
    n = len(padded) - limit - 8
    counts = np.zeros(256, np.int64)
    for a in range(0, n, BATCH):
        counts += np.bincount(padded[a:min(n, a + BATCH)], minlength=256)
    edges, load, room = [0], 0, _room(n, memory)
    for s, c in enumerate(counts.tolist()):
        if load and load + c > room:
            edges.append(s)
            load = 0
        load += c
    return Level(padded[:n], np.array([*edges, 256]), disk, memory, BYTE_WIDTH, limit, padded).suffixes()
