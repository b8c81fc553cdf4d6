"""M1 with any number of classes, taken from the label table.

``classify_multi``: multinomial naive Bayes over a sparse model. Only the
(word, class) pairs that training saw are rows; a word's share in every other
class is the same for all words, so it is one number for each class, times the
known words of the text.

``classify_linear``: softmax regression over hashed words and pairs of
neighbouring words, as linear text classifiers do. A text's features are places
in a table of ``DIMS`` rows. A round computes the gradient of all training
texts in the tasks; gradients of the places that occur are summed by place, in
part before the shuffle, and the driver moves the weights (AdaGrad). Weights
have a fixed size, ``DIMS`` x classes, whatever the vocabulary, and go to the
tasks as a broadcast array; scoring reads texts once and joins nothing.

Nulls: documents without text, or without a known word or any feature, get the
class that is likeliest without them. Labels without class are no labels.
Equal scores: the larger class name wins. No labels: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, broadcast_if_small, checkpoint
from .classify import raw_words

DIMS = 1 << 17
ROUNDS = 12
RATE = 0.5
#: Classes that one model holds; weights are DIMS x classes numbers.
MAX_CLASSES = 1000
#: Bytes of places that a task works on at once.
PART_BYTES = 1 << 20


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(labels.where("class is not null").select("doc_id", "class"), "doc_id")


def _class_sizes(train: DataFrame) -> dict[str, int]:
    sizes = {r["class"]: r["count"] for r in train.groupBy("class").count().limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sizes


# ---------------------------------------------------------------- naive Bayes

class SparseBayes:
    """``table``: word, class, gain (log of count + 1) of the pairs seen;
    ``words``: the vocabulary; ``classes``: (name, log prior, log of the
    smoothed total)."""

    def __init__(self, table: DataFrame, words: DataFrame, classes: list[tuple[str, float, float]]):
        self.table, self.words, self.classes = table, words, classes


def train_multi(docs: DataFrame, labels: DataFrame) -> SparseBayes | None:
    train = _labelled(docs, labels)
    sizes = _class_sizes(train)
    if not sizes:
        return None
    counts = checkpoint(train.select("class", F.explode(raw_words("text")).alias("word")).where("word <> ''")
                        .groupBy("word", "class").agg(F.count("*").alias("n")), "class-counts")
    words = checkpoint(counts.select("word").distinct(), "class-words")
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    v, every = words.count(), sum(sizes.values())
    classes = [(c, math.log(n / every), math.log(totals.get(c, 0) + v) if totals.get(c, 0) + v else 0.0)
               for c, n in sorted(sizes.items())]
    return SparseBayes(counts.select("word", "class", F.log(F.col("n") + 1).alias("gain")), words, classes)


def score_multi(docs: DataFrame, model: SparseBayes) -> DataFrame:
    """(doc_id, category) of every document. Of a text's classes, those with a
    seen pair are rows; all others score by the number of known words alone,
    and the best of them is an expression over the class list."""
    tokens = docs.select("doc_id", F.explode(raw_words("text")).alias("word")).where("word <> ''")
    known = tokens.join(broadcast_if_small(model.words), "word").groupBy("doc_id").agg(F.count("*").alias("n"))
    gains = tokens.join(broadcast_if_small(model.table), "word").groupBy("doc_id", "class").agg(F.sum("gain").alias("gain"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(prior).alias("prior"), F.lit(total).alias("total"))
                      for name, prior, total in model.classes])
    n = F.coalesce("n", F.lit(0))
    plain = F.transform(table, lambda c: F.struct((c["prior"] - n * c["total"]).alias("score"), c["name"].alias("class")))
    seen = gains.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "gain"))).alias("gains"))
    found = docs.select("doc_id").join(known, "doc_id", "left").join(seen, "doc_id", "left").withColumn("plain", plain)
    # at most MAX_CLASSES entries a document
    scored = F.transform("plain", lambda c: F.struct(
        (c["score"] + F.coalesce(F.element_at("gains", c["class"]), F.lit(0.0))).alias("score"), c["class"].alias("class")))
    return found.select("doc_id", F.array_max(scored)["class"].alias("category"))


def classify_multi(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category): learn from (doc_id, class) labels, judge all."""
    model = train_multi(docs, labels)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("category")).limit(0)
    return score_multi(docs, model)


# ---------------------------------------------------------------- linear

def hashed(text: str = "text", dims: int = DIMS) -> F.Column:
    """Places of a text's words and pairs of neighbouring words, each once."""
    words = F.filter(raw_words(F.coalesce(F.col(text), F.lit(""))), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(dims)).cast("int"))
    ones = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    return F.array_distinct(F.concat(ones, pairs))


class Linear:
    """Weights by place and class; the last row is the bias."""

    def __init__(self, weights: np.ndarray, classes: list[str]):
        self.weights, self.classes = weights, classes

    @property
    def dims(self) -> int:
        return len(self.weights) - 1

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        """Class scores of texts, given by their places."""
        sizes = np.array([len(p) for p in places])
        flat = np.concatenate(places) if len(places) else np.zeros(0, np.int64)
        out = np.tile(self.weights[-1], (len(places), 1)).astype(np.float64)
        at = np.flatnonzero(sizes)
        if len(at):
            begin = np.cumsum(sizes[at]) - sizes[at]
            out[at] += np.add.reduceat(self.weights[flat], begin, axis=0) / np.sqrt(sizes[at])[:, None]
        return out


def _places(column) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def _gradient(rows: DataFrame, model, k: int, dims: int) -> DataFrame:
    """place, g0, g1, ...: the loss's gradient over all rows (places, class
    number), at the places that occur."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches_of(batches, PART_BYTES):
            places, y = _places(batch.column(0)), batch.column(1).to_numpy()
            s = model.value.scores(places)
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            if total is None:
                total = np.zeros((dims + 1, k))
            sizes = np.array([len(x) for x in places])
            total[-1] += p.sum(0)
            if sizes.sum():
                row = np.repeat(np.arange(len(places)), sizes)
                share = p[row] / np.sqrt(sizes)[row, None]
                flat = np.concatenate(places)
                for c in range(k):
                    total[:, c] += np.bincount(flat, share[:, c], dims + 1)
        if total is not None:
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, c]) for c in range(k)]],
                                             ["place", *[f"g{c}" for c in range(k)]])

    grads = ", ".join(f"g{c} double" for c in range(k))
    return rows.mapInArrow(run, f"place int, {grads}").groupBy("place").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(k)])


def train_linear(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, rate: float = RATE, dims: int = DIMS) -> Linear | None:
    """Full-batch AdaGrad; the driver holds weights and one gradient, both of
    fixed size."""
    spark = docs.sparkSession
    train = _labelled(docs, labels)
    sizes = _class_sizes(train)
    if not sizes:
        return None
    classes = sorted(sizes)
    number = F.array_position(F.lit(classes), F.col("class")).cast("int") - 1
    rows = checkpoint(train.select(hashed("text", dims).alias("places"), number.alias("y")), "hashed")
    every, k = sum(sizes.values()), len(classes)
    w, squares = np.zeros((dims + 1, k)), np.full((dims + 1, k), 1e-8)
    w[-1] = [math.log(sizes[c] / every) for c in classes]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Linear(w.astype(np.float32), classes))
        got = _gradient(rows, shared, k, dims).toArrow()
        at = got["place"].to_numpy()
        g = np.stack([got[f"g{c}"].to_numpy() for c in range(k)], 1) / every
        squares[at] += g * g
        w[at] -= rate * g / np.sqrt(squares[at])
        shared.unpersist()
    return Linear(w.astype(np.float32), classes)


def score_linear(docs: DataFrame, model: Linear) -> DataFrame:
    """(doc_id, category) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, PART_BYTES):
            s = shared.value.scores(_places(batch.column(1)))
            # the larger of equally good classes
            best = s.shape[1] - 1 - s[:, ::-1].argmax(1) if len(s) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.classes[b] for b in best], pa.string())],
                                             ["doc_id", "category"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", hashed("text", model.dims).alias("places")).mapInArrow(run, f"doc_id {id_type}, category string")


def classify_linear(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category): learn from (doc_id, class) labels, judge all."""
    model = train_linear(docs, labels)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("category")).limit(0)
    return score_linear(docs, model)
