"""Hidden Markov language model against a plain forward recursion."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from newsweave.llm import hmm_lm
from newsweave.llm.words import Words


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tokens(t):
    return [*lower(t or "").encode().split(), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_base(rows):
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, base))
    return out


@pytest.mark.parametrize("table", ["documents", "odd_docs"])
@pytest.mark.parametrize("head", [200, 1 << 17])
def test_base_scores(request, table, head):
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, hmm_lm.score_corpus(docs, rounds=1, head=head).drop("score").collect()), key=repr)
    for g, w in zip(got, sorted(plain_base(rows), key=repr), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_no_training_rows(spark, documents):
    from pyspark.sql import functions as F

    rows = hmm_lm.score_corpus(documents.limit(3), is_held_out=F.lit(True), rounds=1).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
    assert all(np.isfinite(r["score"]) for r in rows)
    assert hmm_lm.score_corpus(documents.limit(0)).count() == 0


def random_model(rng, k, size):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm_lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((size, k)), 0))


def test_forward_and_counts():
    rng = np.random.default_rng(2)
    m = random_model(rng, 3, 6)
    seqs = [rng.integers(0, 6, n).astype(np.int32) for n in (1, 5, 5, 2, 7, 1)]
    want_ll, start, move, emit = [], np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in seqs:  # every path
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        for path in np.ndindex(*[3] * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            p /= total
            start[path[0]] += p
            for t, x in enumerate(s):
                emit[x, path[t]] += p
                if t:
                    move[path[t - 1], path[t]] += p
        want_ll.append(math.log10(total))
    assert np.allclose(hmm_lm.log_likelihood(seqs, m), want_ll)
    lengths = np.array([len(s) for s in seqs])
    got = hmm_lm.expected_counts(np.concatenate(seqs), np.cumsum(lengths) - lengths, lengths, m)
    assert np.allclose(got[0], start, atol=1e-4) and np.allclose(got[1], move, atol=1e-4)
    assert np.allclose(got[2], emit, atol=1e-4) and math.isclose(got[3], sum(want_ll) * math.log(10), rel_tol=1e-4)


def test_training_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = docs.withColumn("held_out", hmm_lm.held_out())
    counts = hmm_lm.written(hmm_lm.word_counts(texts.where("not held_out").select("text")), "t")
    v, _ = hmm_lm.vocabulary(counts, 20_000)
    rows = hmm_lm.written(hmm_lm.encoded(texts.select("doc_id", "held_out", "text"), v), "t")
    model, history = hmm_lm.train(rows, v, rounds=4)
    assert all(b > a for a, b in zip(history, history[1:], strict=False))
    assert math.isclose(model.emit.sum(), model.emit.shape[1], rel_tol=1e-6)
    got = hmm_lm.score_corpus(docs, rounds=4, head=20_000).where("held_out").agg({"score": "sum", "base_score": "sum"})
    r = got.first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_word_hashes():
    import pyarrow as pa

    texts = [None, "", "Ab aB  ab\x0bAB\tab", "x", " y x ", "É é", "ab", "a b"]
    w = Words(pa.array(texts))
    got = [w.hashes[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    words = [lower(t or "").encode().split() for t in texts]
    assert [len(g) for g in got] == [len(x) for x in words]
    seen = {}
    for g, x in zip(got, words, strict=True):
        for h, b in zip(g, x, strict=True):
            assert seen.setdefault(b, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = Words(pa.array(texts).slice(2, 3))
    assert sliced.hashes.tolist() == [h for g in got[2:5] for h in g]


def test_head_of_words_that_share_a_count(spark):
    """More words of one count than the head holds: it is filled by hash."""
    texts = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 500)),) for k in range(0, 4000, 500)], "text string")
    v, tail = hmm_lm.vocabulary(hmm_lm.word_counts(texts), head=1000)
    assert 800 <= len(v.words) <= 1200 and len(v.words) + tail.count() == 4000
