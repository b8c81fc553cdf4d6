"""Channel payload source and the incremental-ingest building blocks.

Landed payloads replace the HTTP fetch: each JSON record is one page of one
channel, ``{"messages": [{"id", "date", "message"}, ...]}``, stored under
``<root>/channel=<name>/`` so the channel comes from partition discovery.

* S1 ``read_messages`` / ``messages_from_payload``, ``bad_records``
* S3 ``active_sources``
* A1 ``high_water``: id of the newest post per source
* F1 ``incremental``: posts newer than the high water, non-empty body
* U3 ``merge_articles``: existing + new, one row per (agency, index)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import epoch_to_time
from ..session import broadcast_if_small, checkpoint

MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.LongType()),
    T.StructField("message", T.StringType()),
])
PAYLOAD = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])
LANDED = T.StructType([*PAYLOAD.fields, T.StructField("channel", T.StringType())])
# a record that doesn't parse keeps its text here
RAW = "_raw"
LANDED_RAW = T.StructType([*LANDED.fields, T.StructField(RAW, T.StringType())])

#: Size of a landed file.
LANDED_FILE_BYTES = 32 << 20


def land_payloads(pages: DataFrame, path: str, file_bytes: int = LANDED_FILE_BYTES) -> str:
    """Write (channel, payload json) rows as JSON lines, one folder per channel
    with files of about ``file_bytes``: their number follows the size of the
    channels, not the number of tasks that made the pages."""
    rows = checkpoint(pages, "pages")
    files = rows.groupBy(F.col("channel").alias("_channel")).agg(
        F.greatest(F.ceil(F.sum(F.octet_length("payload")) / file_bytes), F.lit(1)).alias("_files"))
    part = F.pmod(F.xxhash64("payload"), "_files").alias("_part")
    (rows.join(broadcast_if_small(files), F.col("channel").eqNullSafe(F.col("_channel"))).select("channel", "payload", part)
     .repartition("channel", "_part")
     .select("channel", F.from_json("payload", PAYLOAD)["messages"].alias("messages"))
     .write.mode("overwrite").partitionBy("channel").json(path))
    return path


def land_raw(pages: DataFrame, path: str) -> str:
    """Write payloads as they came in, one line each, one folder per channel."""
    lines = pages.select("channel", F.regexp_replace("payload", r"[\r\n]+", " ").alias("value"))
    lines.write.mode("append").partitionBy("channel").text(path)
    return path


def bad_records(spark: SparkSession, path: str) -> DataFrame:
    """S1 quarantine: (channel, file, reason, record) of every landed line that
    gives no posts. ``reason`` is ``unparsable`` (no JSON object of this form) or
    ``no messages`` (no ``messages`` list in it); ``record`` is the line. Blank
    lines are no records. ``read_messages`` passes over exactly these lines; a
    list without posts is a good record."""
    lines = spark.read.schema("value string, channel string").text(path).where(F.trim("value") != "")
    schema = T.StructType([*PAYLOAD.fields, T.StructField(RAW, T.StringType())])
    r = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW})
    rows = lines.select("channel", F.col("_metadata.file_path").alias("file"), "value", r.alias("r"))
    reason = F.when(F.col("r").isNull() | F.col(f"r.{RAW}").isNotNull(), "unparsable") \
        .when(F.col("r.messages").isNull(), "no messages")
    return rows.select("channel", "file", reason.alias("reason"), F.col("value").alias("record")).where("reason is not null")


def messages_from_payload(payloads: DataFrame, tz: str = "UTC") -> DataFrame:
    """S1 over parsed payload rows (``channel``, ``messages``): one row per
    post with a non-empty body: (agency, index, date, message)."""
    if RAW in payloads.columns:  # half a line may still give some messages
        payloads = payloads.where(F.col(RAW).isNull())
    m = payloads.select(F.col("channel").alias("agency"), F.explode("messages").alias("m"))
    return (m.where(F.col("m.message").isNotNull() & (F.col("m.message") != ""))
            .select("agency", F.col("m.id").alias("index"),
                    epoch_to_time(F.col("m.date"), tz).alias("date"),
                    F.col("m.message").alias("message")))


def landed_reader(reader):
    """A (stream) reader of landed lines with a declared schema; a line that
    doesn't parse keeps its text in ``RAW``."""
    return reader.schema(LANDED_RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)


def read_messages(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Batch read of landed payloads with a declared schema (no inference)."""
    return messages_from_payload(landed_reader(spark.read).json(path), tz)


def active_sources(df: DataFrame, registry: DataFrame) -> DataFrame:
    """S3: rows of active sources only; the registry is one row per source."""
    active = registry.where(F.col("is_active")).select("agency")
    return df.join(broadcast_if_small(active), "agency", "left_semi")


def high_water(stored: DataFrame) -> DataFrame:
    """A1: (agency, high_water) = index of the newest row, ties by index.
    An aggregate, so it combines map-side."""
    return (stored.groupBy("agency")
            .agg(F.max_by("index", F.struct("date", "index")).alias("high_water")))


def incremental(incoming: DataFrame, stored: DataFrame, body: str = "message") -> DataFrame:
    """incoming posts newer than the source's high water (0 for a source
    never seen before) with a non-empty body."""
    hw = high_water(stored)
    j = incoming.join(broadcast_if_small(hw), "agency", "left")
    return (j.where((F.col("index") > F.coalesce("high_water", F.lit(0)))
                    & F.col(body).isNotNull() & (F.col(body) != ""))
            .drop("high_water"))


def merge_articles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing + new, one row per (agency, index), existing rows win."""
    e = existing.withColumn("_src", F.lit(0))
    n = new.withColumn("_src", F.lit(1))
    u = e.unionByName(n)
    cols = [c for c in u.columns if c not in ("agency", "index", "_src")]
    pick = F.min_by(F.struct(*cols), F.col("_src")).alias("r")
    return u.groupBy("agency", "index").agg(pick).select("agency", "index", "r.*")
