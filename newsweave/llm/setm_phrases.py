"""Collocations by set-oriented mining of occurrence relations (SETM).

The relation of length k holds every occurrence of every frequent phrase of k
words: document, position, phrase. It is written sorted by document and
position, one row per document with the occurrences as arrays. Positions count
words and skip one number at each border of pieces, so two occurrences at
adjacent positions are in one piece.

Each length takes three steps, as in SETM:

* merge-join: occurrences of length k at positions p and p + 1 give one of
  length k + 1 at p. Both sides are the same sorted relation, so the join runs
  along each document's arrays, without a shuffle;
* group-count: tasks count their phrases, the counts are summed by phrase;
* semi-join: occurrences of phrases with enough support form the relation of
  the next length. A phrase can only be frequent if both its parts are, so
  nothing is lost. The frequent phrases go to the tasks as one sorted array if it is no
  larger than ``SEMI_BYTES``; beyond that the occurrences are joined with them
  by a shuffle on the phrase and brought back into order.

A word is known by a 64-bit hash of its group and bytes. Frequent phrases of a
length are numbered, and a longer phrase is known by the numbers of the two
shorter ones that it was made from; its words come back through them, as do the
counts of its beginnings and ends.

Score of a phrase: the least floor(1000 * a * n / (l * r)) over its cuts into
two parts (ties: the first cut), in decimals of 38 digits. A candidate is
dropped if a longer one holds it with at least ``PERCENT`` per cent of its
count; a phrase one word longer always decides that, since counts fall with
the length.

Nulls: a null text has no words, a null group is ``und``. Repeated rows and ids count
as often as they are there. Texts of any length are one row each. Equal scores
and counts rank by the phrase's bytes. Empty table, or nothing frequent: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import distributed_row_number
from ..session import broadcast_if_small
from .common import batches_of, written
from .words import Words, letter_values, mixed

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
PERCENT = 100
#: Bytes of frequent phrases (8 each) that go to every task.
SEMI_BYTES = 32 << 20
#: Bytes handled at once; vectors over them take some 40 times as much.
_CHUNK = 1 << 20
#: Numbers up to which two make one 64-bit id.
PACKED = 1 << 31
_BORDERS = b".,;:!?\n\x0b\x0c\r"
_VALUES = letter_values(b" \t" + _BORDERS)
_BORDER = np.zeros(256, bool)
_BORDER[list(_BORDERS)] = True


class Occurrences:
    """Occurrences of some documents: phrase ids and positions behind each
    other, and where each document's end."""

    def __init__(self, ids: np.ndarray, pos: np.ndarray, ends: np.ndarray):
        self.ids, self.pos, self.ends = ids, pos, ends

    def known(self, keys: np.ndarray) -> Occurrences:
        """Those whose ids are among the sorted ``keys``, by their places there."""
        if not len(keys):
            return Occurrences(self.ids[:0], self.pos[:0], np.zeros(len(self.ends), np.int64))
        at = np.minimum(np.searchsorted(keys, self.ids), len(keys) - 1)
        keep = keys[at] == self.ids
        upto = np.concatenate([[0], np.cumsum(keep)])
        return Occurrences(at[keep], self.pos[keep], upto[self.ends])

    def extended(self, n: int) -> tuple[Occurrences, np.ndarray, np.ndarray]:
        """Occurrences one word longer, and the numbers of both their parts;
        ``n`` is how many numbers there are. Ids are both numbers in one, or a
        hash of them if that doesn't fit."""
        if len(self.ids) < 2:
            none = np.zeros(0, np.int64)
            return Occurrences(none, self.pos[:0], np.zeros(len(self.ends), np.int64)), none, none
        joins = self.pos[1:] == self.pos[:-1] + 1
        last = self.ends[(self.ends > 0) & (self.ends < len(self.ids))] - 1
        joins[last] = False
        at = np.flatnonzero(joins)
        left, right = self.ids[at], self.ids[at + 1]
        if n <= PACKED:
            ids = (left << 32) | right
        else:
            ids = _signed(mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(right.astype(np.uint64))))
        return Occurrences(ids, self.pos[at], np.searchsorted(at, self.ends)), left, right

    def columns(self, n: int):
        import pyarrow as pa

        cuts = np.concatenate([[0], self.ends])
        return [pa.array([x[a:b].astype(t).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                for x, t in ((self.pos, "<u4"), (self.ids, _code(n)))]


def _code(n: int) -> str:
    return "<u4" if n <= PACKED else "<i8"


def _stored(pos, ids, n: int) -> Occurrences:
    pos, ids = (c.to_pylist() for c in (pos, ids))
    return Occurrences(np.frombuffer(b"".join(ids), _code(n)).astype(np.int64),
                       np.frombuffer(b"".join(pos), "<u4").astype(np.int64), np.cumsum([len(x) // 4 for x in pos]))


def _group_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _words(groups: list[str], texts) -> tuple[Occurrences, Words]:
    w = Words(texts, _VALUES)
    per = np.diff(w.first)
    salt = np.repeat(np.array([_group_hash(g) for g in groups], np.uint64), per)
    borders = np.searchsorted(np.flatnonzero(_BORDER[w.data]), w.starts)
    new = np.zeros(len(w.starts), np.int64)
    new[1:] = borders[1:] != borders[:-1]
    pos = np.arange(len(new)) + np.cumsum(new)
    first = np.repeat(pos[np.minimum(w.first[:-1], max(0, len(pos) - 1))], per) if len(pos) else pos
    return Occurrences(_signed(mixed(w.hashes + salt)), pos - first, w.first[1:].astype(np.int64)), w


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """group, id, phrase (the word) and a over all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, _CHUNK):
            groups = batch.column(0).to_pylist()
            o, w = _words(groups, batch.column(1))
            ids, first, n = np.unique(o.ids, return_index=True, return_counts=True)
            raw = w.data.tobytes()
            # bytes.lower() changes A-Z alone
            words = [raw[a:b].lower().decode("utf-8", "replace") for a, b in zip(w.starts[first], w.ends[first], strict=True)]
            rows = np.searchsorted(w.first[1:], first, "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[r] for r in rows], pa.string()), pa.array(ids), pa.array(words, pa.string()),
                 pa.array(n, pa.int64())], ["group", "id", "phrase", "n"])

    return docs.mapInArrow(run, "group string, id long, phrase string, n long") \
        .groupBy("group", "id", "phrase").agg(F.sum("n").alias("a"))


def _relation(source: DataFrame, read, frequent: DataFrame, n: int, limit: int) -> DataFrame:
    """row, pos, ids: the occurrences that ``read`` finds in a batch of
    ``source``, of the ``n`` frequent phrases alone and by their numbers."""
    if 8 * n <= limit:
        keys = np.sort(frequent.select("key").toArrow()["key"].to_numpy())
        keys = frequent.sparkSession.sparkContext.broadcast(keys)

        def near(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches_of(batches, _CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0), *read(batch).known(keys.value).columns(n)],
                                                 ["row", "pos", "ids"])

        return source.mapInArrow(near, "row long, pos binary, ids binary").where("octet_length(pos) > 0")

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, _CHUNK):
            o = read(batch)
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(np.concatenate([[0], o.ends])))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(o.pos, pa.int64()),
                                              pa.array(o.ids)], ["row", "pos", "key"])

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        row, pos, ids = None, [], []

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int64()), pa.array([np.concatenate(pos).astype("<u4").tobytes()], pa.binary()),
                 pa.array([np.concatenate(ids).astype(_code(n)).tobytes()], pa.binary())], ["row", "pos", "ids"])

        for batch in batches:
            rows, p, i = (c.to_numpy() for c in batch.columns)
            for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(
                    [[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]])), strict=True):
                if a == b:
                    continue
                if rows[a] != row:
                    if pos:
                        yield one()
                    row, pos, ids = int(rows[a]), [], []
                pos.append(p[a:b])
                ids.append(i[a:b])
        if pos:
            yield one()

    return source.mapInArrow(each, "row long, pos long, key long").join(frequent.select("key", "no"), "key") \
        .select("row", "pos", "no").repartition("row").sortWithinPartitions("row", "pos") \
        .mapInArrow(gather, "row long, pos binary, ids binary")


def _counts(relation: DataFrame, n: int) -> DataFrame:
    """key, lid, rid, a of the phrases one word longer than those of ``relation``."""
    packed = n <= PACKED

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_of(batches, _CHUNK):
            o, left, right = _stored(batch.column(0), batch.column(1), n).extended(n)
            ids, first, count = np.unique(o.ids, return_index=True, return_counts=True)
            parts = [] if packed else [pa.array(x[first]) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *parts, pa.array(count, pa.int64())], [*names, "n"])

    names = ["key"] if packed else ["key", "lid", "rid"]
    out = relation.select("pos", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"])) \
        .groupBy(*names).agg(F.sum("n").alias("a"))
    if packed:
        out = out.select("key", F.shiftright("key", 32).alias("lid"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("rid"), "a")
    return out


def _numbered(phrases: DataFrame) -> DataFrame:
    """With ``no``: the phrase's place in the order of keys, from 0."""
    ranked = distributed_row_number(phrases.withColumn("k", F.lit(0)), ["k"], [F.col("key")], "no")
    return ranked.withColumn("no", F.col("no") - 1).drop("k")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text",
         group_col: str = "lang", semi_bytes: int = SEMI_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length from 1 on, and the word count n of
    each group. A phrase has group, no (its number), phrase, a, the counts of its
    beginnings (``starts``) and ends (``ends``) of 1, 2, ... words, and, from
    two words on, the numbers of its parts without the last (``lid``) and
    without the first word (``rid``)."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("group"),
                       F.col(text_col).cast("string").alias("text"))
    words = written(word_counts(docs.select("group", "text")), "word-counts")
    totals = written(words.groupBy("group").agg(F.sum("a").alias("n")), "word-totals")
    found = [written(_numbered(words.where(F.col("a") >= min_count).select(
        "group", F.col("id").alias("key"), "phrase", F.col("phrase").alias("last"), "a", F.array("a").alias("starts"),
        F.array("a").alias("ends"))), "phrases-1")]

    def of_text(batch) -> Occurrences:
        return _words(batch.column(1).to_pylist(), batch.column(2))[0]

    relation, read = docs, of_text
    for k in range(2, max_words + 1):
        n = found[-1].count()
        if not n:
            break
        relation = written(_relation(relation, read, found[-1], n, semi_bytes), "occurrences")
        counts = _counts(relation, n).where(F.col("a") >= min_count)
        left = found[-1].select(F.col("no").alias("lid"), "group", F.col("phrase").alias("front"), "starts")
        right = found[-1].select(F.col("no").alias("rid"), F.col("last"), F.col("ends"))
        found.append(written(_numbered(
            counts.join(left, "lid").join(right, "rid").select(
                "group", "key", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "a",
                F.concat("starts", F.array("a")).alias("starts"), F.concat("ends", F.array("a")).alias("ends"),
                "lid", "rid")), f"phrases-{k}"))

        def read(batch, n=n) -> Occurrences:
            return _stored(batch.column(1), batch.column(2), n).extended(n)[0]
    return found, totals


def _scored(phrases: DataFrame, k: int) -> DataFrame:
    """With l, r and score of the cut that scores least."""
    wide = "decimal(16,0)"
    a_n = (F.col("a").cast(wide) * F.col("n").cast(wide)) * F.lit(1000).cast("decimal(4,0)")

    def cut(i: int):
        front, rest = F.col("starts")[i - 1], F.col("ends")[k - i - 1]
        return F.struct(F.call_function("div", a_n, front.cast(wide) * rest.cast(wide)).alias("score"),
                        F.lit(i).alias("k"), front.alias("l"), rest.alias("r"))

    return phrases.withColumn("cut", F.array_min(F.array(*[cut(i) for i in range(1, k)])))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 percent: int = PERCENT, text_col: str = "text", group_col: str = "lang",
                 semi_bytes: int = SEMI_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each group's best phrases."""
    found, totals = mine(docs, min_count, max_words, text_col, group_col, semi_bytes)
    out = None
    for k, phrases in enumerate(found[1:], 2):
        if k < len(found):
            longer = found[k]
            held = longer.select(F.col("lid").alias("no"), F.col("a").alias("of")) \
                .unionByName(longer.select(F.col("rid").alias("no"), F.col("a").alias("of"))) \
                .groupBy("no").agg(F.max("of").alias("of"))
            phrases = phrases.join(held, "no", "left").where(
                F.col("of").isNull() | (100 * F.col("of") < percent * F.col("a")))
        best = _scored(phrases.join(broadcast_if_small(totals), "group"), k) \
            .select("group", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "group string, phrase string, a long, l long, r long, n long, score long")
    w = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top) \
        .select(F.col("group").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
