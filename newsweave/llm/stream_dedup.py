"""Exact deduplication as a stateful stream.

Documents arrive as a file stream. The stream's state, kept on disk in RocksDB
without expiry, has one entry per digest of the normalised text: the stable
identifier of the document that stays, its content locator (file and row), and
the number of documents seen. Files that land later go through the same
checkpoint and meet the state of all earlier ones.

A digest that is met again is a hit. The normalised text of every hit is
compared byte by byte with the text at the entry's locator; a document that
differs (two texts, one digest) is grouped by its full text instead, so a weak
digest costs time, not results.

All of it is DataFrame operations: a streaming aggregation (partial sums
before the shuffle, so a hot text is one row per task), the state read as a
table, and equi-joins on the digest, which Spark can split where one digest is
hot.

Normalised: null is empty; every run of blank, tab, LF, VT, FF, CR is one
blank. Of equal texts the smallest ``doc_id`` stays, a null id last; if the
same id has equal text twice, the row at the first locator stays. ``kept`` is
true for one row per group. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import shared_path, written

#: Runs that are not one single blank already.
_RUNS = r"[\t-\r ][\t-\r ]+|[\t-\r]"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(source: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col(text_col))
    return source.select(
        F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), digest(norm).alias("digest"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))


def update_state(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256) -> None:
    """Bring the state up to all files at ``path``; what an earlier call has
    read is not read again."""
    schema = spark.read.parquet(path).schema
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # the same path as a pattern, which may also be that of a single file
    entries = _rows(spark.readStream.schema(schema).parquet(path), id_col, text_col, digest) \
        .groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    conf = {"spark.sql.streaming.stateStore.providerClass": _ROCKS,
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
            # no disk set aside in advance: there are as many stores as shuffle partitions
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        entries.writeStream.outputMode("update").format("noop").option("checkpointLocation", state) \
            .trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep_id, keep_place, n of every entry of the state, whose columns
    carry the names of the aggregate functions."""
    return spark.read.format("statestore").load(state).select(
        F.col("key.digest").alias("digest"), F.col("value.min.doc_id").alias("keep_id"),
        F.col("value.min.place").alias("keep_place"), F.col("value.count").alias("n"))


def deduplicate(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and place (file, row) of
    every row of the Parquet files at ``path``."""
    state = state or shared_path(spark, "dedup-state")
    source = spark.read.parquet(path)
    update_state(spark, path, state, id_col, text_col, digest)
    entries = written(read_state(spark, state), "dedup-entries", "snappy")
    rows = _rows(source, id_col, text_col, digest).withColumn("text_sha256", F.sha2("norm", 256))
    # Texts travel once, and only hits are written with theirs.
    met = written(rows.join(entries, "digest").withColumn("norm", F.when(F.col("n") > 1, F.col("norm"))), "dedup-rows")
    single = met.where("n = 1").select("doc_id", "doc_id", F.lit(1).cast("long"), F.lit(True), "text_sha256", "place") \
        .toDF("doc_id", "keep_id", "group_size", "kept", "text_sha256", "place")
    hits = met.where("n > 1")
    first = hits.where(F.col("place") == F.col("keep_place")).select("digest", F.col("norm").alias("first_norm"))
    checked = written(hits.join(first, "digest").withColumn("same", F.col("norm") == F.col("first_norm"))
                      .withColumn("norm", F.when(~F.col("same"), F.col("norm"))).drop("first_norm"), "dedup-hits")
    # All but the documents that differ are the group; those are few or none.
    differ = checked.where("not same").groupBy("digest").agg(F.count("*").alias("differ"))
    equal = checked.where("same").join(broadcast_if_small(written(differ, "dedup-differ", "snappy")), "digest", "left") \
        .select("doc_id", "keep_id", (F.col("n") - F.coalesce("differ", F.lit(0))).alias("group_size"),
                (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256", "place")
    # Two texts with one digest: grouped by the text itself.
    other = checked.where("not same")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    groups = other.groupBy("norm").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))
    clash = other.join(groups, "norm").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("place") == F.col("first.place")).alias("kept"), "text_sha256", "place")
    return single.unionByName(equal).unionByName(clash)
