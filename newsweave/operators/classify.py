"""M1 classification, F3 non-news filter, M4 batch scoring extension point.

``classify_nb`` is multinomial naive Bayes written as aggregations: word
counts per class (map-side combined), Laplace-smoothed log likelihoods, log
priors, and a per-document argmax. Training and scoring are Spark jobs over
the labelled table and all documents; the model table is joined (broadcast
only behind a size check).

``classify_lr`` is the MLlib pipeline alternative. ``score_batches`` runs a
caller-provided model over Arrow batches (``mapInArrow``); the model is
loaded once per Python worker.
"""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, broadcast_if_small, checkpoint

NEWS, NOT_NEWS = "news", "not_news"
CLASSES = [NOT_NEWS, NEWS]
#: Bytes of texts that a model scores at once.
PART_BYTES = 4 << 20
WORD_SPLIT = r"[^\p{L}]+"


def raw_words(text: Column | str) -> Column:
    """Lower-cased letter runs, possibly with '' at the ends; explode this
    and filter the rows (stays in generated code, unlike a lambda filter)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(t), WORD_SPLIT)


def _class_of(quality: Column) -> Column:
    return F.when(quality == 1, F.lit(NEWS)).otherwise(F.lit(NOT_NEWS))


class NaiveBayes:
    """A trained model: ``table`` (word, one log likelihood per class) and the
    log prior of each class."""

    def __init__(self, table: DataFrame, logprior: dict[str, float]):
        self.table, self.logprior = table, logprior
        self.classes = [c for c in CLASSES if c in logprior]


def train_nb(docs: DataFrame, labels: DataFrame) -> NaiveBayes:
    """Multinomial naive Bayes from the labelled documents. Labels are joined
    before texts are exploded, and one aggregation counts a word for all
    classes; that table is written once and gives the vocabulary, the totals
    and the model. The driver reads two rows of totals."""
    lab = labels.select("doc_id", _class_of(F.col("quality")).alias("class"))
    train = docs.select("doc_id", "text").join(lab, "doc_id")
    n_of = lambda c: F.count(F.when(F.col("class") == c, 1))
    counts = checkpoint(train.select("class", F.explode(raw_words("text")).alias("word")).where("word <> ''")
                        .groupBy("word").agg(*[n_of(c).alias(c) for c in CLASSES]), "nb-counts")
    size = docs.select("doc_id").join(lab, "doc_id").agg(*[n_of(c).alias(c) for c in CLASSES]).first()
    totals = counts.agg(F.count("*").alias("v"), *[F.sum(c).alias(c) for c in CLASSES]).first()
    every = sum(size[c] for c in CLASSES)
    logprior = {c: math.log(size[c] / every) for c in CLASSES if size[c]}
    table = counts.select("word", *[F.log((F.col(c) + 1) / F.lit(float((totals[c] or 0) + totals["v"]))).alias(c)
                                    for c in logprior])
    return NaiveBayes(table, logprior)


def score_nb(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """(doc_id, category) for every document: argmax of log prior + sum of
    word log likelihoods (unknown words ignored).

    The per-document sum combines map-side to one row per document, so no
    (document, word) table is built or shuffled."""
    tokens = docs.select("doc_id", F.explode(raw_words("text")).alias("word")).where(F.col("word") != "")
    ll = (tokens.join(broadcast_if_small(model.table), "word").groupBy("doc_id")
          .agg(*[F.sum(F.col(c)).alias(f"_ll_{c}") for c in model.classes]))
    scored = docs.select("doc_id").join(ll, "doc_id", "left")
    options = [F.struct((F.lit(model.logprior[c]) + F.coalesce(F.col(f"_ll_{c}"), F.lit(0.0))).alias("score"),
                        F.lit(c).alias("class")) for c in model.classes]
    best = F.greatest(*options) if len(options) > 1 else options[0]   # ties: larger class name
    return scored.select("doc_id", best["class"].alias("category"))


def classify_nb(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category): train on the labelled documents, score all."""
    return score_nb(docs, train_nb(docs, labels))


def drop_not_news(df: DataFrame) -> DataFrame:
    """F3."""
    return df.where(F.col("category") != NOT_NEWS)


def classify_lr(docs: DataFrame, labels: DataFrame, num_features: int = 1 << 18) -> DataFrame:
    """M1(b): RegexTokenizer -> HashingTF -> IDF -> LogisticRegression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    train = docs.join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="toks", pattern=WORD_SPLIT, toLowercase=True),
        HashingTF(inputCol="toks", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ])
    model = pipe.fit(train)
    pred = model.transform(docs.select("doc_id", "text"))
    return pred.select("doc_id", F.when(F.col("prediction") == 1.0, F.lit(NEWS))
                       .otherwise(F.lit(NOT_NEWS)).alias("category"))


class LengthModel:
    """Stand-in model for ``score_batches``: share of letters in the text.
    Real callers pass their own class with ``load()`` and ``predict(Series)``."""

    @classmethod
    def load(cls) -> LengthModel:
        return cls()

    def predict(self, texts: pd.Series) -> pd.Series:
        t = texts.fillna("")
        letters = t.str.count(r"[^\W\d_]")
        return (letters / t.str.len().clip(lower=1)).round(6)


def _once_per_worker(key: str, make: Any) -> Any:
    """The functions of this package travel by value, so their module globals
    are new in every task; ``sys.modules`` lives as long as the worker."""
    import sys
    import types
    held = sys.modules.setdefault("_newsweave_models", types.ModuleType("_newsweave_models")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def score_batches(df: DataFrame, model_cls: Any, text_col: str = "text",
                  id_col: str = "doc_id") -> DataFrame:
    """M4: (id, score) with ``model_cls.load()`` once per Python worker. The
    model gets texts in parts of some MB, however large Spark's batches are."""
    name = f"{model_cls.__module__}.{model_cls.__qualname__}"

    def run(batches):
        import pyarrow as pa

        model = _once_per_worker(name, model_cls.load)
        for batch in batches_of(batches, PART_BYTES):
            pdf = batch.to_pandas()
            scores = model.predict(pdf[text_col]).astype("float64")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64(), from_pandas=True)],
                                             [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double")
