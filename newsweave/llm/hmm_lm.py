"""Hidden Markov language model over the words of a corpus.

Hidden states emit words; every text is its words and one end. States are
trained by Baum-Welch: each task runs scaled forward and backward passes over
its documents, its expected counts (starts, transitions, emissions) are summed
over all tasks, and the driver normalises them into the next model. A text's
score is its exact log10 likelihood by the scaled forward recursion over the
whole text.

The emission table is bounded: the commonest words up to ``HEAD`` have entries
of their own, each other word belongs to one of ``TAILS`` classes by its last
three bytes. A state emits a class, and the class its word with probability
(c + 0.1) / (C + 0.1 * (V + 1)), where C and V are the class's training tokens
and distinct words; the last 0.1 is for all unknown words. Counts of all words
stay a table of the corpus's size, joined with the words of the texts that are
not in the head; every word keeps its exact count.

Words are keyed by 64-bit hashes (``words.py``). Training cuts a text every
``SEGMENT`` tokens, so a task's memory is a batch of segments; each segment
starts from the initial distribution. Scoring cuts nothing.

Nulls: null text counts as empty, one end token. A null id is in training (its
text has no remainder). Repeated rows are documents of their own. Nothing in
training: every word is unknown, N = V = 0. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import estimated_bytes
from .common import batches_of, sum_pieces, to_pieces, written
from .lpt_shards import size_class
from .words import _LOWER, Words, mixed

STATES = 8
ROUNDS = 5
HEAD = 1 << 17
TAILS = 512
SEGMENT = 256
ALPHA = 0.1
#: Share of the unigram distribution in every state's emissions.
FLOOR = 0.02
#: Bytes of encoded text for one task of a training round.
ROUND_BYTES = 128 << 20
#: Key of the end token; a word meets it by chance only.
END = 0
_CHUNK = 4 << 20
_BATCH_TOKENS = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def tail_class(words: Words) -> np.ndarray:
    """Class of each word by its last three bytes, case aside."""
    code = np.zeros(len(words.starts), np.uint64)
    for k in (1, 2, 3):
        at = words.ends - k
        byte = _LOWER[words.data[np.maximum(at, 0)]] if len(words.data) else code
        code = code * np.uint64(260) + np.where(at >= words.starts, byte, np.uint64(0))
    return (mixed(code) % np.uint64(TAILS)).astype(np.int32)


# ----------------------------------------------------------------- counts

def word_counts(texts: DataFrame) -> DataFrame:
    """word, class, c of the tokens of a text column."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        size = docs = 0

        def merge() -> tuple:
            word, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(word, kind="stable")
            word, kind, n = word[order], kind[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            return word[at], kind[at], np.add.reduceat(n, at)

        def rows(word, kind, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kind), pa.array(n)],
                                              ["word", "class", "c"])

        for batch in batches_of(batches, _CHUNK):
            w = Words(batch.column(0))
            docs += batch.num_rows
            if not len(w.hashes):
                continue
            word, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            held.append((word, tail_class(w)[first], n.astype(np.int64)))
            size += len(word)
            if size > 3_000_000:
                held = [merge()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*merge())
        if docs:
            yield rows(np.array([END], np.uint64), np.zeros(1, np.int32), np.array([docs], np.int64))

    return texts.mapInArrow(run, "word long, class int, c long").groupBy("word") \
        .agg(F.min("class").alias("class"), F.sum("c").alias("c"))


class Vocabulary:
    """Symbols: 0 the end, then the head words by hash, then the classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end: int, tail_tokens: np.ndarray,
                 tail_words: np.ndarray, total: int, distinct: int):
        self.words, self.total, self.distinct = words, total, distinct
        self.counts = np.concatenate([[end], counts, tail_tokens]).astype(float)
        self.head = 1 + len(words)
        self.base_log = math.log10(total + ALPHA * (distinct + 1))
        self.class_log = np.log10(tail_tokens + ALPHA * (tail_words + 1))

    @property
    def size(self) -> int:
        return len(self.counts)

    def symbols(self, w: Words) -> np.ndarray:
        at = np.searchsorted(self.words, w.hashes)
        known = np.zeros(len(at), bool)
        inside = at < len(self.words)
        known[inside] = self.words[at[inside]] == w.hashes[inside]
        return np.where(known, at + 1, self.head + tail_class(w)).astype(np.int32)


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The bounded vocabulary, and the counts of all other words. The head's
    least count comes from a histogram of counts, so nothing is sorted."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != END)
    histogram = words.groupBy(F.expr(size_class("c")).alias("least")).count().collect()
    least, n, part = 1 << 62, 0, 0
    for r in sorted(histogram, key=lambda r: -r["least"]):
        if n + r["count"] > head:  # of the class that overflows, a share by hash
            part = (head - n) * 4096 // r["count"]
            break
        n += r["count"]
        least = r["least"]
    below = [r["least"] for r in histogram if r["least"] < least]
    edge = max(below, default=least)
    inside = (F.col("c") >= least) | ((F.col("c") >= edge) & (F.shiftrightunsigned("word", 52) < part))
    top = words.where(inside).select("word", "c").toArrow()
    key, c = top["word"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    tail = words.where(~inside)
    tokens, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in tail.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["class"]], kinds[r["class"]] = r["c"], r["v"]
    end = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return Vocabulary(key[order], c[order], end, tokens, kinds, total, distinct), tail.select("word", "c")


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, held_out, n_tokens, ids (symbols, 32-bit) and tail (hashes of
    the words outside the head, as often as they occur)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, _CHUNK):
            w = Words(batch.column(2))
            ids = v.symbols(w)
            rare = ids >= v.head
            upto = np.concatenate([[0], np.cumsum(rare)])
            tail = w.hashes[rare]
            spans = list(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(w.first) + 1),
                 pa.array([np.append(ids[a:b], np.int32(0)).tobytes() for a, b in spans], pa.binary()),
                 pa.array([tail[upto[a]:upto[b]].tobytes() for a, b in spans], pa.binary())],
                ["doc_id", "held_out", "n_tokens", "ids", "tail"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, ids binary, tail binary")


# ------------------------------------------------------------------ model

class Model:
    """Initial, transition and emission probabilities; emissions by symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def unigram(v: Vocabulary) -> np.ndarray:
    return (v.counts + ALPHA) / (v.counts.sum() + ALPHA * v.size)


def first_model(v: Vocabulary, states: int = STATES, seed: int = 7) -> Model:
    """Sticky states, and emissions around the unigram distribution that differ
    by a fixed random pattern."""
    rng = np.random.default_rng(seed)
    emit = unigram(v)[:, None] * np.exp(rng.standard_normal((v.size, states)))
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def expected_counts(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, m: Model) -> tuple:
    """Starts, transitions, emissions and log likelihood of sequences
    ``ids[starts[i]:starts[i] + lengths[i]]``, all moved on side by side."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0])
    # sequences still running at step t are the first live[t]
    live = np.searchsorted(-lengths, -np.arange(steps), "left")
    at = np.concatenate([[0], np.cumsum(live)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], live)
    flat = ids[starts[place] + np.repeat(np.arange(steps), live)]  # by step, then sequence
    emit = m.emit.astype(np.float32)[flat]
    move, back = m.move.astype(np.float32), np.ascontiguousarray(m.move.T.astype(np.float32))
    alpha, scale = np.empty_like(emit), np.empty((len(flat), 1), np.float32)
    a = m.start.astype(np.float32) * emit[:live[0]]
    for t in range(steps):
        lo, hi = at[t], at[t + 1]
        if t:
            a = (alpha[at[t - 1]:at[t - 1] + hi - lo] @ move) * emit[lo:hi]
        s = a.sum(1, keepdims=True)
        np.divide(a, s, out=alpha[lo:hi])
        scale[lo:hi] = s
    emit /= scale
    beta = np.ones_like(emit)
    for t in range(steps - 1, 0, -1):  # beta of step t - 1 from step t
        lo, hi = at[t], at[t + 1]
        ahead = emit[lo:hi] * beta[lo:hi]
        emit[lo:hi] = ahead
        beta[at[t - 1]:at[t - 1] + hi - lo] = ahead @ back
    before = np.concatenate([np.arange(at[t - 1], at[t - 1] + live[t]) for t in range(1, steps)]) \
        if steps > 1 else np.zeros(0, np.int64)
    moves = m.move * (alpha[before].T.astype(float) @ emit[live[0]:].astype(float))
    gamma = alpha * beta
    k = gamma.shape[1]
    words = np.stack([np.bincount(flat, gamma[:, j], len(m.emit)) for j in range(k)], 1)
    return gamma[:live[0]].sum(0, dtype=float), moves, words, float(np.log(scale.astype(float)).sum())


def round_of(train: DataFrame, m: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all training rows: the next model's counts
    and this model's log likelihood (natural)."""
    k, size = m.emit.shape[1], len(m.emit)

    def run(batches: Iterator) -> Iterator:
        start, move, emit, ll = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0
        held: list[np.ndarray] = []
        n = 0

        def add() -> None:
            nonlocal ll
            ids = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            got = expected_counts(ids, np.cumsum(lengths) - lengths, lengths, m)
            start[:] += got[0]
            move[:] += got[1]
            emit[:] += got[2]
            ll += got[3]

        for batch in batches_of(batches, _CHUNK):
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, np.int32)
                for i in range(0, len(ids), SEGMENT):
                    held.append(ids[i:i + SEGMENT])
                n += len(ids)
                if n >= _BATCH_TOKENS:
                    add()
                    held, n = [], 0
        if held:
            add()
        yield to_pieces(np.concatenate([[ll], start, move.ravel()]))
        yield to_pieces(emit.ravel(), "<f4", 1 << 16)  # the bulk; summed in doubles

    small, emit = sum_pieces(train.select("ids").mapInArrow(run, "piece int, data binary"),
                             [(1 + k + k * k, "<f8"), (size * k, "<f4")])
    start, move = np.split(small[1:], [k])
    return Model(start, move.reshape(k, k), emit.reshape(size, k)), float(small[0])


def normalised(counts: Model, v: Vocabulary) -> Model:
    part = lambda x, axis: (x + 1e-3) / (x + 1e-3).sum(axis, keepdims=True)
    emit = counts.emit / np.maximum(counts.emit.sum(0, keepdims=True), 1e-9)
    emit = (1 - FLOOR) * emit + FLOOR * unigram(v)[:, None]
    return Model(part(counts.start, 0), part(counts.move, 1), emit / emit.sum(0))


def train(rows: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """``rounds`` Baum-Welch rounds over the training rows of ``encoded``; the
    model and each round's log likelihood."""
    data = rows.where("not held_out")
    data = data.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism,
                             math.ceil(estimated_bytes(rows) / ROUND_BYTES)))
    m, history = first_model(v, states), []
    for _ in range(rounds):
        counts, ll = round_of(data, m)
        history.append(ll)
        m = normalised(counts, v)
    return m, history


def log_likelihood(ids: list[np.ndarray], m: Model) -> np.ndarray:
    """Exact log10 likelihood of whole sequences by the scaled forward
    recursion."""
    lengths = np.array([len(x) for x in ids])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([ids[i] for i in order])
    sorted_ = lengths[order]
    starts = np.cumsum(sorted_) - sorted_
    total = np.zeros(len(ids))
    n, a = len(ids), None
    for t in range(int(sorted_[0])):
        while sorted_[n - 1] <= t:
            n -= 1
        emit = m.emit[flat[starts[:n] + t]]
        a = (m.start if t == 0 else a[:n] @ m.move) * emit
        s = a.sum(1)
        a /= s[:, None]
        total[:n] += np.log10(s)
    out = np.empty(len(ids))
    out[order] = total
    return out


def scored(rows: DataFrame, m: Model, v: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, n_tokens, known, base, score without the share of
    the words outside the head."""
    log_c = np.log10(v.counts + ALPHA)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, 16 << 20):
            ids = [np.frombuffer(x, np.int32) for x in batch.column(4).to_pylist()]
            upto = np.cumsum([len(x) for x in ids])
            flat = np.concatenate(ids)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(0, upto)])
            rare = flat >= v.head
            kind = np.where(rare, flat - v.head, 0)
            base = np.where(rare, 0.0, log_c[flat]) - v.base_log
            score = log_likelihood(ids, m) - sums(np.where(rare, v.class_log[kind], 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums((~rare & (v.counts[flat] > 0)).astype(np.int64))),
                 pa.array(sums(base)), pa.array(score)],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    return rows.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")


def score_corpus(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD,
                 id_col: str = "doc_id", text_col: str = "text", is_held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row, by a model learned from the rows not held out."""
    out = is_held_out if is_held_out is not None else held_out(id_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    counts = written(word_counts(docs.where("not held_out").select("text")), "words", "snappy")
    v, tail = vocabulary(counts, head)
    rows = written(encoded(docs, v).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model, _ = train(rows, v, states, rounds)
    first = written(scored(rows, model, v), "scored", "snappy")

    def words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, _CHUNK):
            got = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in got])),
                 pa.array(np.concatenate(got))], ["row", "word"])

    # Words outside the head meet their counts; a word that training lacks has none.
    met = rows.select("row", "tail").mapInArrow(words, "row long, word long").join(tail, "word", "left")
    share = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("share"),
                                   F.count("c").alias("met"))
    share = share.withColumnRenamed("row", "of")
    return first.join(share, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("share", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("share", F.lit(0.0))).alias("score"))
