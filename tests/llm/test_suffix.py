"""Repeated byte strings against plain counting of windows."""

import numpy as np
import pytest

from newsweave.llm import suffix_dedup as sd


def plain_removed(rows, length):
    """doc_id, bytes, maximal removed runs, kept bytes; rows in their order."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone]).astype(int)))
        out.append((rows[k][0], len(raw), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)),
                    bytes(b for b, g in zip(raw, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def check(docs, length=100, ordered=True, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["n_bytes"], [(x["start"], x["end"]) for x in r["removed"]], bytes(r["kept"]))
                  for r in sd.remove(docs, length, **options).collect()), key=repr)
    want = plain_removed(rows, length)
    assert got == want
    return got


def test_documents(documents):
    assert any(r[2] for r in check(documents))


@pytest.mark.parametrize("options", [{"memory": 64}, {"hot": 1}, {"hot": 3, "memory": 500}])
def test_small_memory_and_hot_owners(documents, options):
    """Sorted on disk, and every owner dealt again."""
    check(documents.where("doc_id < 60"), **options)


def test_odd(spark, odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("hot", [sd.HOT, 2])
def test_passages(spark, hot):
    """Passages at document edges, overlaps, runs of one byte, texts of just
    the length, nulls, repeated ids; extra columns named like internal ones."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    p, q = word(150), word(100)
    texts = [p, word(70) + p + word(20), p[10:] + q, q, q[:-1], "x" + q, q + q[:50] + q, "a" * 400, "a" * 100, "a" * 99, None, "",
             word(500)] + [word(60) + p + word(40) for _ in range(30)]
    texts += [texts[-1], texts[-1] + "!", "é漢😀" * 60, "漢😀é" * 60]
    rows = [(None if k == 12 else 5 if k in (5, 6) else 100 - k, t, k, "z") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, place string").coalesce(1)
    check(docs, hot=hot)


def test_very_long(spark):
    """A text over several chunks of windows, with a passage across their
    border."""
    rng = np.random.default_rng(8)
    body = bytes(rng.integers(97, 123, sd._CHUNK * 2 + 1000, np.uint8)).decode()
    passage = body[sd._CHUNK - 300:sd._CHUNK + 300]
    docs = spark.createDataFrame([(1, body), (2, "0" + passage + "1"), (0, body[-500:])], "doc_id long, text string")
    got = check(docs)
    assert [r[2] for r in got if r[0] == 2] == [[(1, 601)]]


def test_empty(documents):
    assert check(documents.limit(0)) == []


def test_windows_sorted():
    """Before the sort: pieces that share their owner alone go, of the others
    the windows near what they share stay, with every repeated one."""
    rng = np.random.default_rng(6)
    length, gram, owner = 100, 40, bytes(range(40))
    near = bytes(rng.integers(97, 123, 60, np.uint8))
    texts = [bytes(rng.integers(97, 123, 60, np.uint8)) + owner + bytes(rng.integers(97, 123, 60, np.uint8)) for _ in range(20)]
    texts += [texts[0][:60] + owner + near, texts[1][:25] + near[:35] + owner + near]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    away = np.full(len(texts), 60)
    hashes, has = sd.core_hashes(np.frombuffer(b"".join(texts), np.uint8), at, np.zeros(len(texts), np.int64), away, length, gram)
    piece, first, n = sd.kept_windows(sd.met_twice(hashes, has), away, np.diff(at) - (length - 1), length, gram)
    kept = {(p, w) for p, a, k in zip(piece.tolist(), first.tolist(), n.tolist(), strict=True) for w in range(a, a + k)}
    windows = [(p, w, t[w:w + length]) for p, t in enumerate(texts) for w in range(len(t) - length + 1)]
    several = {(p, w) for p, w, s in windows if sum(s == x[2] for x in windows) > 1}
    assert several and several <= kept and {p for p, _ in kept} == {0, 20, 21}
    assert len(kept) <= len(several) + 3 * sd.CORE_STEP
