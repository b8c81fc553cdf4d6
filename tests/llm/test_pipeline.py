"""The pipeline's stages, each against its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from newsweave.llm import centroid_langid, hash_mix
from newsweave.llm.common import written

from .test_documents import plain_components, plain_groups, words


@pytest.fixture(scope="module", params=["documents", "odd_docs"])
def staged(spark, request):
    docs, out = request.getfixturevalue(request.param), []
    for name, stage in cp.STAGES[:-1]:
        kept = written(stage(spark, docs, ""), "test")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        out.append((name, docs, kept))
        docs = kept
    return out, docs


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(staged):
    (_, raw, lang), (_, _, exact), (_, _, near), (_, _, mixed) = staged[0]
    model = centroid_langid.fit(raw, F.lit(True))
    told = centroid_langid.predict(raw, model)
    assert rows(lang) == rows(told.where("not rejected").select(*raw.columns))
    letters = [any(c.isalpha() for c in r["text"] or "") for r in told.collect()]
    # too few texts to learn a distance: those without letters go, and no others
    assert told.where("rejected").count() == letters.count(False) or raw.count() > 50
    assert told.where("rejected").count() <= letters.count(False) + 0.02 * letters.count(True)
    groups = plain_groups([(r["doc_id"], r["text"]) for r in lang.collect()])
    assert not rows(exact) - rows(lang) and exact.count() == len({g[3] for g in groups})
    parts = plain_components([(k, r["text"]) for k, r in enumerate(exact.collect())], 80, 5)
    assert not rows(near) - rows(exact) and near.count() == len({p[2] for p in parts})
    assert not set(rows(mixed)) - set(rows(near))
    taken = hash_mix.mix(near).agg({"taken": "sum"}).first()[0]
    assert sum(len(words(r["text"])) for r in mixed.collect()) == taken


CLASHES = ["score", "rejected", "lang_pred", "place", "row", "__place", "__row", "__n", "of", "n", "copy", "hash2", "r"]


def test_clashing_names(spark, documents):
    """Columns named like those that the stages add stay as they are."""
    docs = documents.limit(40).select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    docs = written(docs.unionByName(docs.limit(5)), "test")
    given = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "test")
        assert docs.columns == [*documents.columns, *CLASHES] and docs.count() > 0
        assert all(given[r["doc_id"]] == tuple(r) for r in docs.collect())


def test_empty(spark, documents):
    docs = documents.limit(0)
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, ""), "test")
        assert docs.count() == 0


def test_run(spark, documents):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
