"""External induced sorting against plain sorting of all suffixes."""

import numpy as np
import pytest

from newsweave.llm import induced_sort
from newsweave.llm.induced_sort import Disk, Sorter, double_prefixes, sorted_suffixes


def plain_suffixes(t):
    return sorted(range(len(t) - 1), key=lambda i: t[i:], reverse=True)


def common(a, b, limit):
    n = 0
    while n < limit and n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def check(body, limit, memory):
    t = bytes(body) + b"\0"
    padded = np.frombuffer(t + b"\0" * (limit + 8), np.uint8)
    got = list(sorted_suffixes(padded, limit, Disk(memory), memory))
    pos = np.concatenate([g[0] for g in got]).tolist() if got else []
    shared = np.concatenate([g[1] for g in got]).tolist() if got else []
    want = plain_suffixes(t)
    assert pos == want
    for k in range(1, len(want)):
        # beyond the end symbol there is padding
        real = common(t[want[k - 1]:], t[want[k]:], limit)
        assert shared[k] == real, (k, want[k - 1], want[k])
    if shared:
        assert shared[0] == 0


@pytest.mark.parametrize("memory", [4, 16, 64, 1 << 20])
@pytest.mark.parametrize("top", [1, 2, 3, 20, 254])
def test_random(memory, top):
    rng = np.random.default_rng(top * 1000 + memory % 997)
    for n in (0, 1, 2, 3, 7, 40, 300):
        check(rng.integers(1, top + 1, n, np.uint8), 20, memory)


@pytest.mark.parametrize("memory", [8, 1 << 20])
@pytest.mark.parametrize("text", [b"a" * 500, b"ab" * 300, b"abcabcabd" * 60, b"mississippi" * 20, b"zyxwvutsrqponml" * 20,
                                  b"abcdefghijklm" * 20, b"aaaaab" * 50 + b"a" * 100, bytes(range(1, 255)) * 3,
                                  b"the cat. the dog, the cat. " * 15 + b"x" + b"the cat. the dog, the cat. " * 15])
def test_repeats(text, memory):
    check(text, 100, memory)


def test_fibonacci():
    a, b = b"a", b"ab"
    while len(b) < 2000:
        a, b = b, b + a
    for memory in (16, 1 << 20):
        check(b, 254, memory)


@pytest.mark.parametrize("memory", [3, 50, 10_000])
def test_sorter(memory):
    rng = np.random.default_rng(memory)
    s, rows = Sorter(Disk(memory), memory), []
    for _ in range(20):
        a, b = rng.integers(0, 9, 37).astype(np.uint64), rng.integers(0, 2**63, 37).astype(np.uint64)
        c = np.arange(37)
        s.push(a, b, c)
        rows += zip(a.tolist(), b.tolist(), c.tolist(), strict=True)
    got = [r for block in s.blocks() for r in zip(*(c.tolist() for c in block), strict=True)]
    assert [r[:2] for r in got] == [r[:2] for r in sorted(rows)] and sorted(got) == sorted(rows)


def test_doubling():
    """Names that fit the memory are sorted without a deeper level."""
    rng = np.random.default_rng(9)
    for top, n in ((1, 1), (2, 300), (3, 2000), (400, 2000)):
        body = rng.integers(1, top + 1, n)
        names = np.append(np.concatenate([body, body[:n // 2], body]), 0).astype(np.uint32)
        order = np.argsort(names, kind="stable").astype(np.int32)
        double_prefixes(names, order)
        assert order.tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_few_levels(monkeypatch):
    widths, level = [], induced_sort.Level.__init__

    def init(self, text, edges, disk, memory, width, *rest):
        widths.append(width)
        level(self, text, edges, disk, memory, width, *rest)

    monkeypatch.setattr(induced_sort.Level, "__init__", init)
    check(b"the cat. the dog, the cat. " * 40, 100, 1 << 20)
    assert widths == [induced_sort.BYTE_WIDTH]
    check(b"the cat. the dog, the cat. " * 40, 100, 64)
    assert len(widths) > 2
