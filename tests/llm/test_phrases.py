"""Collocations against plain counting."""

import re
from collections import Counter

import pytest

from newsweave.llm import setm_phrases as sp


def plain_collocations(rows, min_count, max_words=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i:i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    frequent = {key: a for key, a in f.items() if a >= min_count}
    out = []
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        longer = [b for (g, v), b in frequent.items() if g == lang and len(v) > len(w) and b >= a
                  and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if not longer:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]],
                                         f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    got = []
    for lang in {r[0] for r in out}:
        ranked = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        got += [(lang, k, *r[1:]) for k, r in enumerate(ranked[:top], 1)]
    return sorted(got)


def check(docs, min_count, **options):
    got = sorted(tuple(r) for r in sp.collocations(docs, min_count, **options).collect())
    assert got == plain_collocations([(r["text"], r["lang"]) for r in docs.collect()], min_count, top=options.get("top", 2000))
    return got


def test_documents(documents):
    assert check(documents, 20)


def test_semi_join_by_shuffle(documents):
    """No room to send the frequent phrases to the tasks: the same rows."""
    assert check(documents, 20, semi_bytes=0)


@pytest.mark.parametrize("semi_bytes", [sp.SEMI_BYTES, 0])
@pytest.mark.parametrize("min_count", [1, 2])
def test_odd(spark, odd_docs, min_count, semi_bytes):
    rows = [("A b. b a, a b\tA  b\nb\x0ba b", None), ("a b c d e f. a b c d e", "de"), ("a b c d e f", "de"), ("a a a a a a", "x"),
            ("", "x"), (None, None), ("é É é É. é", "fr"), ("b a b a;b a", "und"), ("k " * 3000, "y")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "text string, lang string, id string, row int")
    check(docs, min_count, semi_bytes=semi_bytes, top=5)
    assert check(odd_docs, min_count, semi_bytes=semi_bytes)


def test_many_phrases(documents, monkeypatch):
    """More numbers than fit twice in 64 bits: ids by hash."""
    monkeypatch.setattr(sp, "PACKED", 0)
    assert check(documents.where("doc_id < 100"), 5) and check(documents.where("doc_id < 100"), 5, semi_bytes=0)


def test_empty(documents):
    assert check(documents.limit(0), 1) == [] and check(documents, 10**9) == []
