"""Words of an Arrow column of texts as 64-bit hashes, by vector operations
over the column's bytes.

A word is a run of bytes other than blank, tab, LF, VT, FF, CR; A-Z counts as
a-z. Its hash is a polynomial in its bytes modulo 2**64, mixed with its
length. Two words out of n meet by chance with about n**2 / 2**65: one in ten
million for a million words.
"""

from __future__ import annotations

import numpy as np

from .common import SPACES


def letter_values(between: bytes) -> np.ndarray:
    """A byte's value in the hash: 0 for those between words, A-Z as a-z."""
    values = np.arange(256, dtype=np.uint64) + np.uint64(1)
    values[65:91] += np.uint64(32)
    values[list(between)] = 0
    return values


_LOWER = letter_values(SPACES.encode())
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:  # doubling: the second half is the first times base ** done
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % (1 << 64)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of all words of a string column: ``hashes[first[i]:first[i + 1]]``
    are those of row i. ``data[starts[k]:ends[k]]`` are the bytes of word k.
    ``values`` says which bytes lie between words (see ``letter_values``)."""

    def __init__(self, column, values: np.ndarray = _LOWER):
        import pyarrow as pa

        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else \
            np.zeros(0, np.uint8)
        at = offsets - offsets[0]
        inside = (values > 0)[data]
        cut = np.zeros(len(data) + 1, bool)  # a row begins here
        cut[at] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.data, self.starts, self.ends = data, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, at)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        length = self.ends - self.starts
        span = np.diff(np.append(self.starts, len(data)))  # to the next word
        value = values[data[self.starts[0]:]]
        place = np.arange(len(value)) - np.repeat(self.starts - self.starts[0], span)
        value *= powers(int(span.max()))[place]
        total = np.add.reduceat(value, self.starts - self.starts[0])
        self.hashes = mixed(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: Words, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of n words (a shorter text is one window), where
    each row's begin, one more at the end, and the sum of the ``weight`` of
    each window's words. Windows repeat as in the text."""
    h, first = words.hashes, words.first
    weight = np.zeros(len(h), np.int64) if weight is None else weight
    sizes = np.diff(first)
    made = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(made)])
    out, total = np.zeros(upto[-1], np.uint64), np.zeros(upto[-1], np.int64)
    full = np.flatnonzero(sizes >= n)
    if len(full):
        inside = np.arange(made[full].sum()) - np.repeat(np.cumsum(made[full]) - made[full], made[full])
        at, to = np.repeat(first[full], made[full]) + inside, np.repeat(upto[full], made[full]) + inside
        s = h[at]
        for k in range(1, n):
            s = mixed(s + np.uint64(k)) + h[at + k]
        out[to] = mixed(s + np.uint64(n))
        sums = np.concatenate([[0], np.cumsum(weight)])
        total[to] = sums[at + n] - sums[at]
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):
        s = h[first[i]:first[i] + 1]
        for k in range(1, int(sizes[i])):
            s = mixed(s + np.uint64(k)) + h[first[i] + k:first[i] + k + 1]
        out[upto[i]:upto[i] + 1] = mixed(s + np.uint64(1000 + int(sizes[i])))
        total[upto[i]] = weight[first[i]:first[i + 1]].sum()
    return out, upto, total
