"""M2 extractive summary and M3 headline, as Spark jobs over the whole text.

Sentences are scored by the mean document frequency of their words (Luhn
1958): a word's weight is how often it occurs in the document; a sentence's
score is the mean weight of its words. The summary takes sentences from the
best down, ``k`` at most, and passes over each that shares ``GRAM`` words in a row
with those taken, so no run of that length stands in it twice by two sentences;
they keep their original order. The headline is the best sentence cut to
``n`` words. All counts are integers, so the scores are exact ratios and the
ranking does not depend on summation order.

Everything happens inside one document, so the texts are dealt by document
once, into tasks of few MB. Spark cuts texts into sentences and words; the
counts of a batch's words, their sums by sentence and the ranks are array
operations over Arrow columns, so no word becomes a row that is sorted.

The neural summariser and headline model are not reproduced (their weights
are not available); this is the extractive stand-in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, estimated_bytes
from .classify import raw_words

SENTENCE = r"[^.!?\n]+[.!?]*"
#: Words in a row that two sentences of a summary must not share.
GRAM = 4
#: Bytes of input (as stored) for a task, down to two tasks for a small batch.
TASK_BYTES = 1 << 20


def sentences(text: str = "text") -> F.Column:
    return F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0)


def _greedy(ranked: list[int], words, k: int) -> list[int]:
    """Sentence numbers taken from the best down, without shared runs;
    ``words(i)``: the word numbers of sentence ``i``."""
    taken, grams = [], set()
    for i in ranked:
        w = words(i)
        mine = {tuple(w[j:j + GRAM]) for j in range(len(w) - GRAM + 1)}
        if grams.isdisjoint(mine):
            taken.append(i)
            grams |= mine
            if len(taken) == k:
                break
    return sorted(taken)


def _best_sentences(k: int):
    """(doc_id, sentences, words of each sentence) -> (doc_id, the ``k``
    sentences of the summary in their order, the best sentence); documents
    without a word give no row."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches_of(batches, 4 << 20):
            per_doc = batch.column(2).value_lengths().fill_null(0).to_numpy()
            inner = batch.column(2).flatten()
            per_sent = inner.value_lengths().to_numpy()
            coded = inner.flatten().dictionary_encode()
            codes, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            ends = np.cumsum(per_sent)
            doc = np.repeat(np.arange(len(per_doc)), per_doc)      # of a sentence
            sent = np.repeat(np.arange(len(per_sent)), per_sent)   # of a word
            word = codes != (known.index("") if "" in known else -1)
            sent = sent[word]
            _, at, n = np.unique(doc[sent] * len(known) + codes[word], return_inverse=True, return_counts=True)
            total = np.bincount(sent, n[at], len(per_sent))
            count = np.bincount(sent, minlength=len(per_sent))
            found = np.flatnonzero(count)
            score = total[found] / count[found]
            order = found[np.lexsort((found, -score, doc[found]))]  # best first: by falling score, then by place

            def words(i: int) -> list[int]:
                mine = slice(ends[i] - per_sent[i], ends[i])
                return codes[mine][word[mine]].tolist()

            docs, begin = np.unique(doc[order], return_index=True)
            texts = batch.column(1).flatten()
            picks = [_greedy(ranked.tolist(), words, k) for ranked in np.split(order, begin[1:])] if len(docs) else []
            offsets = np.cumsum([0, *map(len, picks)])
            flat = np.array([i for p in picks for i in p], dtype="int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts.take(pa.array(flat))),
                 texts.take(pa.array(order[begin]))], ["doc_id", "best", "first"])

    return run


def summaries(docs: DataFrame, k: int = 2, n_words: int = 12) -> DataFrame:
    """(doc_id, summary, headline) of every document with a word."""
    spark = docs.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, math.ceil(estimated_bytes(docs) / TASK_BYTES)))
    cut = docs.select("doc_id", "text").repartition(tasks, "doc_id").select("doc_id", sentences().alias("s")).select(
        "doc_id", "s", F.transform("s", lambda x: raw_words(F.trim(x))).alias("words"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = cut.mapInArrow(_best_sentences(int(k)), f"doc_id {kind}, best array<string>, first string")
    tokens = F.filter(F.split(F.trim("first"), r"\s+"), lambda t: t != "")
    return found.select("doc_id", F.array_join(F.transform("best", lambda x: F.trim(x)), " ").alias("summary"),
                        F.array_join(F.slice(tokens, 1, n_words), " ").alias("headline"))


def summarise(docs: DataFrame, k: int = 2) -> DataFrame:
    """M2: (doc_id, summary)."""
    return summaries(docs, k).select("doc_id", "summary")


def headline(docs: DataFrame, n_words: int = 12) -> DataFrame:
    """M3: (doc_id, headline) best sentence, first ``n_words`` words."""
    return summaries(docs, 1, n_words).select("doc_id", "headline")
