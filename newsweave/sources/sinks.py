"""Sinks: append-only article and user logs, dated snapshots, ingest metrics.

* S4 ``append_articles``: partitioned by ``digest_date`` for slot pruning, one
  folder per batch, so that a batch written again replaces itself
* S5 ``append_user_log``: every user table (users, settings, digests sent,
  locations) is an append log; current settings are W4 in users.py
* S6 ``snapshot``: overwrite of one dated partition, idempotent per day
* S7 ``ingest_metrics``: per-source counts and time range
* T7 ``deliver``: digests not yet in the log of digests sent
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint


def append_articles(df: DataFrame, path: str, batch: str) -> None:
    """Add the rows of one batch, partitioned by slot date (partition
    pruning on read). ``batch`` names the job that makes them: run again, it
    replaces its own rows and no others. Rows of a date are dealt together
    first, a large date over several tasks (``rebalance`` splits it), so a
    date gets few files."""
    df.hint("rebalance", "digest_date").write.mode("overwrite").partitionBy("digest_date").parquet(f"{path}/batch={batch}")


def append_user_log(df: DataFrame, path: str) -> None:
    """Append rows to a user log table."""
    df.write.mode("append").parquet(path)


def snapshot(df: DataFrame, root: str, day: str) -> str:
    """Dated copy; rewriting the same day replaces only that day."""
    path = f"{root.rstrip('/')}/snapshot_date={day}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
SENT = "user_id long, sent_at timestamp_ntz, digest_date date, part int, text string"


def _slot_prints(keys: DataFrame) -> DataFrame:
    """(digest_date, part, ...): how many users each slot has, and what two
    64-bit hashes of them come to: sums that need no shuffle of the users."""
    one, two = F.xxhash64("user_id", F.lit(1)), F.xxhash64("user_id", F.lit(2))
    return keys.groupBy("digest_date", "part").agg(
        F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"),
        F.sum(F.shiftright(one, 32)).alias("s"))


def deliver(spark: SparkSession, texts: DataFrame, log: str, sent_at: F.Column, exists: bool = True,
            keys: DataFrame | None = None) -> None:
    """Append to the log the digests (user_id, digest_date, part, text) that
    it does not hold yet, with the time of sending. One write, so a job that
    failed left nothing, and one run again after its end adds nothing. Which
    digests are new is found by the keys alone (``keys`` if they can be had
    without the texts), texts are read for those only. A slot whose users in
    the log are those due, by their number and hashes of 128 bits, is done;
    users are compared one by one in the others.
    ``exists`` is false for the first delivery of all."""
    slot = [F.col("digest_date").cast("date").alias("digest_date"), F.col("part").cast("int").alias("part")]
    new = texts.select("user_id", sent_at.cast("timestamp_ntz").alias("sent_at"), *slot, "text")
    if exists:
        key = ["user_id", "digest_date", "part"]
        due = new.select(*key) if keys is None else keys.select("user_id", *slot)
        equal = lambda cols: [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cols]
        prints = checkpoint(_slot_prints(due), "due-slots")
        # the slots are partition folders: others are pruned at run time
        sent = read_deliveries(spark, log).select(*key).join(
            F.broadcast(prints.select(*key[1:])), key[1:], "left_semi")
        open_slots = checkpoint(prints.alias("t").join(_slot_prints(sent).alias("s"), equal(prints.columns), "left_anti")
                                .select(*key[1:]), "open-slots")
        if open_slots.isEmpty():
            return
        due = checkpoint(due.alias("t").join(F.broadcast(open_slots).alias("s"), equal(key[1:]), "left_semi"), "due")
        sent = sent.join(F.broadcast(open_slots), key[1:], "left_semi")
        missing = checkpoint(due.alias("t").join(sent.alias("s"), equal(key), "left_anti"), "undelivered")
        if missing.isEmpty():
            return
        new = new.alias("t").join(broadcast_if_small(missing).alias("s"), equal(key), "left_semi")
    # texts that come in the order of the slots are not sorted again: a task has few open files, and sorts if it meets more slots
    was = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, "4")
    try:
        new.write.mode("append").partitionBy("digest_date", "part").parquet(log)
    finally:
        spark.conf.set(OPEN_FILES, was)


def read_deliveries(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(SENT).parquet(log)


def ingest_metrics(df: DataFrame) -> DataFrame:
    """(agency, n_articles, first_date, last_date)."""
    return (df.groupBy("agency")
            .agg(F.count("*").alias("n_articles"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date")))
