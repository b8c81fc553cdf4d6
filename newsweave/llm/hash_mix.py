"""Mixing sources to target weights by hash-threshold histograms.

Sizes are words. Sources in code point order, null last, take the weights in
turn; they share ``ratio`` times all words, and a source takes at most
``max_repeats`` times its own words, the excess going to the others by weight.

A target is a number of whole passes over the source and a remainder. The
remainder is a budget for documents below a threshold of their hash: words are
summed by source and hash bucket, the bucket in which the budget runs out is
the only one refined (by the next bits, from its documents alone), until one
hash value is left. If several rows have it (equal in id and text), their row
numbers are hashed and the same search goes on among them. The last document
goes in if the sum then is nearer to the budget. No rows are sorted, and a
larger budget takes a superset of a smaller one's documents, as the threshold only rises.

The histogram has at most 4,096 rows per source and level; a hash has six
levels. Targets and thresholds are one row per source and stay tables.

Nulls: null text has size 0, null source is a source of its own, sorted last.
Of rows equal in id and text, which are interchangeable, as many are taken as
the budget asks for. Empty table: no rows. ``apply_mix`` keeps the columns of
its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import WORD_RE, free_names, written

LEVEL_BITS = 12
WEIGHTS = (5.0, 2.0, 1.0)


def words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              second: str | None = None) -> DataFrame:
    more = [F.col(second).alias("hash2")] if second else []
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       words(F.col(text_col)).alias("size"), row_hash(id_col, text_col).alias("hash"), *more)


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = 1.5,
            max_repeats: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per
    source. Sharing the excess again until none is above its cap ends at one
    level: target = min(cap, level * weight). Sources by cap / weight are
    capped one after the other; the level is that of the first one whose share
    fits."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    t = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(max_repeats))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0.0))) \
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))) \
        .withColumn("level", (F.sum("source_size").over(every) * float(ratio) - F.col("capped"))
                    / F.col("open_weight")) \
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.withColumn("at", level).select("source", "source_size", F.when(
        F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, passes, edge, edge2, edge_in: a document is
    taken ``passes`` times and once more if its (hash, hash2) is below (edge,
    edge2), or equal to it and ``edge_in``."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = written(goals.withColumn("passes", passes.cast("int"))
                    .withColumn("want", F.col("target") - F.col("passes") * F.col("source_size")), "goals", "snappy")
    first = _edges(rows, goals.select("source", "want").where("want > 0"), "hash")
    one = first.where("rows = 1").select("source", "edge", F.lit(None).cast("long").alias("edge2"),
                                         (F.col("want") * 2 >= F.col("n")).alias("edge_in"))
    many = written(first.where("rows > 1").select("source", "edge", "want"), "equal-rows", "snappy")
    if many.take(1):
        m = many.select(F.col("source").alias("of"), "edge")
        equal = rows.join(broadcast_if_small(m), F.col("source").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("edge")))
        last = _edges(equal.select("source", "size", "hash2"), many.select("source", "want"), "hash2") \
            .select(F.col("source").alias("of"), F.col("edge").alias("edge2"), (F.col("want") * 2 >= F.col("n")).alias("edge_in"))
        one = one.unionByName(many.join(last, F.col("source").eqNullSafe(F.col("of"))).select("source", "edge", "edge2", "edge_in"))
    f = one.withColumnRenamed("source", "of")
    return written(goals.join(broadcast_if_small(f), F.col("source").eqNullSafe(F.col("of")), "left")
                   .select("source", "source_size", "target", "passes", "edge", "edge2", "edge_in"), "thresholds", "snappy")


def _edges(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """source, edge, n, rows, want: the value of ``key`` in which the budget
    ``want`` of ``state`` runs out, the words and rows that have it, and what
    is left of the budget there."""
    left, found = rows, None
    for level in range(1, 7):
        shift = max(0, 64 - LEVEL_BITS * level)
        bucket = F.shiftright(key, shift)
        hist = left.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("n"), F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
        s = broadcast_if_small(state.select(F.col("source").alias("of"), "want"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        edge = hist.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("upto", upto) \
            .where("upto >= want and upto - n < want") \
            .withColumn("want", F.col("want") - (F.col("upto") - F.col("n"))).drop("upto")
        edge = written(edge, "edges", "snappy")  # one row per source
        done = edge.where("low = high").select("source", F.col("low").alias("edge"), "n", "rows", "want")
        found = done if found is None else found.unionByName(done)
        state = edge.where("low < high").select("source", "want", "bucket")
        if not state.take(1):
            break
        b = broadcast_if_small(state.select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket")))
        left = left.join(b, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("in_bucket"))) \
            .drop("of", "in_bucket")
    return found


def _copies(hash_: Column, hash2: Column, t: dict[str, Column]) -> Column:
    """How often a row is taken; ``t`` has the columns of its source's thresholds."""
    last = t["edge2"].isNull() | (hash2 < t["edge2"])
    at_edge = F.when(last & t["edge2"].isNotNull(), F.lit(True)) \
        .when(t["edge2"].isNull() | (hash2 == t["edge2"]), t["edge_in"]).otherwise(F.lit(False))
    more = (hash_ < t["edge"]) | ((hash_ == t["edge"]) & at_edge)
    return t["passes"] + F.coalesce(more, F.lit(False)).cast("int")


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, hash of every row, and hash2 of its number."""
    return slim_rows(docs, id_col, text_col, source_col).withColumn("hash2", F.xxhash64(F.monotonically_increasing_id()))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = 1.5, max_repeats: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    rows = written(_numbered(docs, id_col, text_col, source_col), "sizes", "snappy")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, max_repeats)
    t = thresholds(rows, goals).withColumnRenamed("source", "of")
    copies = _copies(F.col("hash"), F.col("hash2"), {c: F.col(c) for c in ("passes", "edge", "edge2", "edge_in")})
    return rows.join(broadcast_if_small(t), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = 1.5, max_repeats: int = 2,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    names = docs.columns
    second, of, n, copy = free_names(docs, "hash2", "of", "n", "copy")
    docs = written(docs.withColumn(second, F.xxhash64(F.monotonically_increasing_id())), "to-mix")
    rows = written(slim_rows(docs, id_col, text_col, source_col, second).drop("doc_id"), "sizes", "snappy")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, max_repeats)
    t = thresholds(rows, goals)
    t = t.select(F.struct("source", "passes", "edge", "edge2", "edge_in").alias(of))
    times = _copies(row_hash(id_col, text_col), F.col(second), {c: F.col(f"{of}.{c}") for c in ("passes", "edge", "edge2", "edge_in")})
    joined = docs.join(broadcast_if_small(t), F.col(source_col).cast("string").eqNullSafe(F.col(f"{of}.source")))
    return joined.withColumn(n, times).where(F.col(n) > 0) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))) \
        .select(*[F.col(f"`{c}`") for c in names])
