"""Classifiers with as many classes as the label table has."""

from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from newsweave.operators import categories, summarise
from newsweave.operators import classify as classify_ops

from conftest import SF_ORACLE

ROWS = [(1, "red apple red"), (2, "green apple pear"), (3, "blue sky sky"), (4, "sky blue red"), (5, None), (6, "unknown words"),
        (7, "Apple, apple!"), (8, "sky"), (9, "")]
LABELS = [(1, "fruit"), (2, "fruit"), (3, "sky"), (4, "sky"), (5, "none"), (9, None), (99, "fruit")]


@pytest.fixture
def tables(spark):
    return (spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(LABELS, "doc_id long, class string"))


def words(t):
    import re
    return [w for w in re.split(r"[^a-z]+", (t or "").lower()) if w]


def plain_bayes(rows, labels):
    lab = {i: c for i, c in labels if c is not None}
    train = [(words(t), lab[i]) for i, t in rows if i in lab]
    sizes, counts = Counter(c for _, c in train), {c: Counter() for _, c in train}
    for w, c in train:
        counts[c].update(w)
    vocabulary = {w for k in counts.values() for w in k}
    out = []
    for i, t in rows:
        known = [w for w in words(t) if w in vocabulary]
        out.append((i, max((round(log(sizes[c] / len(train)) + sum(log((counts[c][w] + 1) / (sum(counts[c].values()) + len(vocabulary)))
                                                                  for w in known), 9), c) for c in counts)[1]))
    return out


def test_sparse_bayes_is_bayes(spark, tables):
    got = sorted(tuple(r) for r in categories.classify_multi(*tables).collect())
    assert got == plain_bayes(ROWS, LABELS)


@pytest.mark.parametrize("classify", [categories.classify_multi, categories.classify_linear])
def test_no_labels_and_no_documents(spark, tables, classify):
    docs, labels = tables
    assert classify(docs, labels.limit(0)).count() == 0 and classify(docs.limit(0), labels).count() == 0


def test_linear_odd_texts(spark, tables):
    got = dict(tuple(r) for r in categories.classify_linear(*tables).collect())
    assert len(got) == len(ROWS) and [got[i] for i in (1, 2, 3, 4)] == ["fruit", "fruit", "sky", "sky"]
    assert got[8] == "sky" and set(got.values()) <= {"fruit", "sky", "none"}


@pytest.mark.parametrize("classify", [categories.classify_multi, categories.classify_linear])
def test_held_out_accuracy(spark, classify):
    """Four languages, learned from two thirds of the documents."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 0
    labels = docs.where(train).select("doc_id", F.col("lang").alias("class"))
    got = classify(docs.select("doc_id", "text"), labels).join(docs, "doc_id").where(~train)
    hits, n = got.agg(F.avg((F.col("category") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 200 and hits > 0.95


def test_summary_repeats_no_four_words(spark):
    text = ("alpha beta gamma delta one. alpha beta gamma delta two. alpha beta epsilon zeta. "
            "alpha beta gamma zeta. short. alpha beta.")
    got = summarise.summaries(spark.createDataFrame([(1, text), (2, "a b c d e. a b c d e. x."), (3, "one. one."), (4, "")],
                                                    "doc_id long, text string"), 3).collect()
    by = {r["doc_id"]: r["summary"] for r in got}
    assert by[1].count("alpha beta gamma delta") <= 1 and by[2] == "a b c d e. x." and by[3] == "one. one."
    assert 4 not in by


def test_summaries_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "... !!\n"), (4, "one"), (5, "B b. A a. c. A a! b b\n"), (6, "x1y. -. x y x.")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["summary"], r["headline"]) for r in summarise.summaries(docs, 2, 1).collect()}
    assert got == {4: ("one", "one"), 5: ("B b. A a.", "B"), 6: ("x1y. x y x.", "x")}
    assert summarise.summaries(docs.where("doc_id < 4")).count() == 0


def test_models_get_bounded_parts(spark):
    """However many rows a batch of Spark's holds, a model sees some MB of text at once."""
    class Longest:
        @classmethod
        def load(cls):
            return cls()

        def predict(self, texts):
            return texts.str.len() * 0.0 + texts.str.len().sum()

    docs = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat('abcdefgh', 8192) text")
    got = [r["score"] for r in classify_ops.score_batches(docs, Longest).collect()]
    assert len(got) == 400 and max(got) <= 8 << 20
