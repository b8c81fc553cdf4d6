"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from newsweave.llm import merkle_rollup as mr


def plain_h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, **new):
    values = [new.get(c, r[c]) for c in mr.FIELDS]
    return plain_h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    """The root, and each leaf's (place, run) of each level."""
    paths, at, cur = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(cur) > 1:
        runs = [cur[i:i + 8] for i in range(0, len(cur), 8)]
        for path, k in zip(paths, at, strict=True):
            path.append((k % 8, runs[k // 8]))
        at, cur = [k // 8 for k in at], [plain_h(*run) for run in runs]
    return cur[0], paths


def plain_manifest(rows):
    by, out = {}, []
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    trees = {}
    for lang, members in by.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[lang] = plain_tree([plain_leaf(r) for r in members])
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    root, above = plain_tree([trees[x][0] for x in order]) if order else (None, [])
    for lang, up in zip(order, above, strict=True):
        for r, path in zip(by[lang], trees[lang][1], strict=True):
            path = path + up
            third = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = r["text"] if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            folded = plain_leaf(r, text=text) if third else plain_leaf(r)
            for at, run in path:
                folded = plain_h(*run[:at], folded, *run[at + 1:])
            proof = plain_h(*[x for at, run in path for k, x in enumerate(run) if k != at])
            out.append((r["doc_id"], plain_leaf(r), trees[lang][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["documents", "odd_docs", "empty"])
def test_manifest(spark, request, name):
    docs = request.getfixturevalue("odd_docs" if name == "empty" else name)
    docs = docs.limit(0) if name == "empty" else docs
    if "n_chars" not in docs.columns:
        docs = docs.withColumnRenamed("ids", "n_chars")
    got = sorted((tuple(r) for r in mr.verify(docs).collect()), key=repr)
    assert got == plain_manifest(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 4097])
def test_heights(spark, n):
    """Runs of one node, one leaf alone, several blocks; extra columns named
    like internal ones."""
    docs = spark.range(n).selectExpr("id as doc_id", "'s' as source", "if(id = 0, null, 'x') as lang", "id as n_chars",
                                     "concat('Text ', id) as text", "'a' as rank", "'b' as `group`", "1 as total", "0 as block")
    got = sorted((tuple(r) for r in mr.verify(docs).collect()), key=repr)
    assert got == plain_manifest(docs.collect())
    assert all(r[-1] == (zlib.crc32(str(r[0]).encode()) % 3 != 0) for r in got)
