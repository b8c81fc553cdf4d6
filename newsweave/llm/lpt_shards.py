"""Longest-processing-time scheduling of documents into shards.

Documents with equal text form a group and stay together. Groups, largest
first, go to the shard with the least bytes so far, taken from a heap.

Only the histogram of group sizes goes through that heap. Groups of one size
class are interchangeable, so the driver gets (class, groups, bytes) and
decides how many groups of each class a shard receives; the groups themselves
are ranked inside their class by a range sort and look up their shard. A class
is an exact size below ``2 ** MANTISSA_BITS`` bytes and the leading bits of
larger sizes, at most ``2 ** MANTISSA_BITS`` classes per power of two, so the
histogram is bounded (about 40,000 rows up to 2 ** 50 bytes) however many
groups there are. A group that is alone in its class, as the large ones are,
counts with its exact size.

``slot`` numbers a shard's documents from 0 without gaps: numbers inside each
task plus the sizes of the tasks before it (one row per task and shard).

Law: ``bytes`` (sizes near equal). ``grown_shard`` is null under this law.

Nulls: null text counts as empty text (size 1, CRC 0, one group with empty
texts). Null ``doc_id`` is carried as null; repeated ``doc_id`` are rows of
their own. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, estimated_bytes
from .common import n_tasks, written

MANTISSA_BITS = 10
LAW = "bytes"


def size_class(col: str) -> str:
    """SQL of a size's class: its leading MANTISSA_BITS + 1 bits."""
    low = f"greatest(length(bin({col})) - {MANTISSA_BITS + 1}, 0)"
    return f"shiftleft(shiftright({col}, {low}), {low})"


def lpt(classes: list[tuple[float, int]], n_shards: int) -> list[list[int]]:
    """For (size, number of items) from the largest size down, how many items
    each shard gets if every item goes to the least loaded shard."""
    heap = [(0.0, s) for s in range(n_shards)]
    out = []
    for size, n in classes:
        given = [0] * n_shards
        if n > 4 * n_shards and size > 0:
            # Items land where the load before them is least: those are the n
            # smallest of load + j * size. All below a level go at once.
            loads = dict((s, x) for x, s in heap)
            below = lambda t: [max(0, int(np.ceil((t - loads[s]) / size))) for s in range(n_shards)]
            lo, hi = heap[0][0], max(x for x, _ in heap) + size * n
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(below(mid)) <= n else (lo, mid)
            given = below(lo)
            n -= sum(given)
            heap = [(loads[s] + given[s] * size, s) for s in range(n_shards)]
            heapq.heapify(heap)
        for _ in range(n):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        out.append(given)
    return out


def assign(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = written(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_key")), "sizes", "snappy")
    parts = n_tasks(spark, estimated_bytes(slim))
    groups = slim.groupBy("text_key").agg(F.sum("size").alias("bytes")) \
        .withColumn("class", F.expr(size_class("bytes")))
    # Ranked inside the class: a range sort, then numbers inside each task.
    ranked = written(
        groups.repartitionByRange(parts, F.col("class").desc(), "text_key")
        .sortWithinPartitions(F.col("class").desc(), "text_key")
        .select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")),
        "groups", "snappy")
    runs = ranked.groupBy("task", "class").agg(F.count("*").alias("n"), F.min("place").alias("first"),
                                               F.sum("bytes").alias("bytes"))
    runs = written(runs, "runs", "snappy")
    classes = [(r["class"], r["bytes"] / r["n"], r["n"]) for r in
               runs.groupBy("class").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()]
    classes.sort(key=lambda c: (-c[1], -c[0]))
    given = lpt([(size, n) for _, size, n in classes], n_shards)
    plan = spark.createDataFrame(
        [(c, [int(x) for x in np.cumsum(g)]) for (c, _, _), g in zip(classes, given, strict=True)],
        "class long, upto array<long>")
    before = runs.select("task", "class", "first", F.coalesce(F.sum("n").over(
        Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before")).join(plan, "class")
    # The shard is the first whose cumulated number exceeds the rank.
    placed = ranked.join(broadcast_if_small(before), ["task", "class"]) \
        .withColumn("rank", F.col("before") + F.col("place") - F.col("first")) \
        .select("text_key", F.expr("size(filter(upto, x -> x <= rank))").cast("int").alias("shard"))

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        for batch in batches:
            shard = batch.column(3).to_numpy()
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=n_shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
            seen += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shard), task), pa.int32()), pa.array(local)],
                [*batch.schema.names, "task", "local"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    numbered = written(slim.join(placed, "text_key").select("doc_id", "size", "text_crc32", "shard").mapInArrow(
        number, f"doc_id {kind}, size long, text_crc32 long, shard int, task int, local long"), "shards", "snappy")
    tasks = numbered.groupBy("task", "shard").agg(F.count("*").alias("n"))
    offsets = tasks.select("task", "shard", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("offset"))
    return numbered.join(broadcast_if_small(offsets), ["task", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("local") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
