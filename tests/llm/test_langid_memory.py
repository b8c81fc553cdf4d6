"""Memory of language ID's tasks: their functions run here, without workers."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from newsweave.llm import centroid_langid
from newsweave.llm.common import worker_cache

LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyz "))


@pytest.fixture
def tasks(spark, monkeypatch):
    """Functions given to Arrow operators, with the columns that these read."""
    got = {"mapInArrow": [], "applyInArrow": []}
    rows = spark.range(1)
    for kind, name in ((type(rows), "mapInArrow"), (type(rows.groupBy("id")), "applyInArrow")):
        monkeypatch.setattr(kind, name, lambda self, f, *a, own=getattr(kind, name), to=got[name], **b:
                            to.append((f, getattr(self, "columns", None))) or own(self, f, *a, **b))
    return got


def texts(n, size=300, seed=1):
    signs = np.random.default_rng(seed).choice(LETTERS, (n, size))
    return ["".join(x) for x in signs]


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def cached():
    return "_newsweave_worker_cache" in sys.modules


def test_predicting_holds_one_matrix_of_a_block(spark, documents, tasks):
    model = centroid_langid.fit(documents, F.lit(True))
    tasks["mapInArrow"].clear()
    centroid_langid.predict(documents.select("text"), model)
    (run, _), = tasks["mapInArrow"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts(1024))], ["text"])
    worker_cache(("tokenizer", "of an earlier job"), list)
    peak, out = peak_mb(lambda: [b.num_rows for b in run(iter([batch]))])
    assert sum(out) == 1024 and not cached()
    assert peak < 20  # 512 rows are 8 MB


def test_fitting_holds_one_matrix_of_its_sample(spark, documents, tasks):
    centroid_langid.fit(documents, F.lit(True))
    (learn, _), = tasks["applyInArrow"]
    counted = [centroid_langid.counts_of(t) for t in texts(1000)]
    at = [np.flatnonzero(c) for c, _ in counted]
    table = pa.table({"label": ["en"] * 1000, "letters": [n for _, n in counted],
                      "places": [a.astype("<u2").tobytes() for a in at],
                      "counts": [c[a].astype("<u4").tobytes() for (c, _), a in zip(counted, at, strict=True)]})
    del counted, at
    worker_cache(("tokenizer", "of an earlier job"), list)
    peak, out = peak_mb(lambda: learn((pa.scalar("en"),), table))
    assert out.num_rows == centroid_langid.CENTROIDS and not cached()
    assert peak < 26  # 1,000 rows are 16 MB


def test_counting_tasks_give_caches_back(spark, documents, tasks):
    centroid_langid.fit(documents, F.lit(True))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["some words"])], ["label", "text"])
    for run, columns in tasks["mapInArrow"]:
        worker_cache(("tokenizer", "of an earlier job"), list)
        list(run(iter([batch if len(columns) == 2 else batch.select(["text"])])))
        assert not cached()


def test_vectors_and_means_are_the_plain_ones():
    """In place and in parts, to the last bit."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 255, 257, 700):
        counts = rng.poisson(0.4, (n, centroid_langid.DIMS))
        idf = rng.random(centroid_langid.DIMS).astype(np.float32) + 1
        plain = np.log1p(counts).astype(np.float32) * idf
        plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-12)
        x = centroid_langid.unit_vectors(np.log1p(counts).astype(np.float32), idf)
        assert np.array_equal(x, plain)
        rows = np.arange(n) % 3 == 0
        assert np.array_equal(centroid_langid.mean_of(x, rows), x[rows].mean(0))


def test_stage_sends_each_text_once(spark, documents, tasks):
    cp.language_id(spark, documents, "")
    _, columns = tasks["mapInArrow"][-1]
    assert len(columns) == len(documents.columns)


def test_stage_finds_the_text_by_any_case(spark, documents):
    docs = documents.withColumnRenamed("text", "Text")
    kept = cp.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, cp.language_id(spark, documents, "").collect()))
