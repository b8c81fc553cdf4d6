"""T3 slot aggregation over a stream, T4 late data.

All slot edges are whole hours, so the stream keeps hourly window counts
(state: one row per hour) and the hours are rolled up to slots afterwards.
The hourly aggregate runs in ``complete`` mode so that the last, still open
hour is also reported when an ``availableNow`` run ends.

Slots that close (``stream_slot_close``): with a watermark of one hour, the
hourly aggregate appends an hour once it can't change any more, and the state
holds open hours alone. A slot is handed on, once, when an hour at or after
its end was appended; closed hours of slots still open wait in a small table.

Late data: an article that arrives one hour or more after its slot ended is
not in that slot's sent digest; ``late_rows`` counts them per slot and the
slots they touch are the ones to recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import digest_date, slot_part
from ..session import checkpoint, shared_path

SLOT = ["digest_date", "part"]


def hourly_counts(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Hourly tumbling windows on the wall-clock time (``timestamp_ntz``, so
    the session time zone plays no part)."""
    return (stream.groupBy(F.window(F.col(ts).cast("timestamp_ntz"), "1 hour").alias("w"))
            .agg(F.count("*").alias("n")))


def roll_up_slots(hours: DataFrame) -> DataFrame:
    start = F.col("w.start")
    return (hours.select(digest_date(start).alias("digest_date"), slot_part(start).alias("part"), "n")
            .groupBy(*SLOT).agg(F.sum("n").alias("n_events")))


def stream_slot_counts(spark: SparkSession, folder: str, schema: T.StructType,
                       glob: str = "events*.parquet", max_files: int | None = None) -> DataFrame:
    """Events per slot from a parquet file stream over ``folder`` (only
    files matching ``glob``; new files are picked up by later runs)."""
    out = shared_path(spark, "hourly")
    ckpt = shared_path(spark, "ckpt-hourly")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(folder)

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (hourly_counts(stream).writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return roll_up_slots(spark.read.parquet(out))


def slot_of_hours(hours: DataFrame) -> DataFrame:
    """The slot of each hour (w, n), and when the slot ends."""
    from ..functions.time import slot_bounds
    named = hours.select("w", "n", digest_date(F.col("w.start")).alias("digest_date"), slot_part(F.col("w.start")).alias("part"))
    return named.withColumn("slot_end", slot_bounds("digest_date", "part")[1])


def run_slot_close(spark: SparkSession, stream: DataFrame, out: str, ckpt: str, ts: str = "ts", delay: str = "1 hour") -> None:
    """One run: slots that closed since the last one are added under
    ``out``/slots; each batch reads only the hours that the one before left
    open, and writes folders of its id with overwrite."""
    hours = (stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
             .groupBy(F.window("_ts", "1 hour").alias("w")).agg(F.count("*").alias("n")))

    def write(batch: DataFrame, batch_id: int) -> None:
        wall = F.struct(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"))
        rows = checkpoint(batch.select(wall.alias("w"), "n"), "closed-hours")
        if batch_id:
            rows = rows.unionByName(spark.read.parquet(f"{out}/open/batch_id={batch_id - 1}").select("w", "n"))
        rows = slot_of_hours(rows)
        horizon = rows.agg(F.max("w.end")).first()[0]
        done = F.col("slot_end") <= F.lit(horizon).cast("timestamp_ntz") if horizon is not None else F.lit(False)
        rows.where(done).groupBy(*SLOT).agg(F.sum("n").alias("n_events")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{out}/slots/batch_id={batch_id}")
        rows.where(~done).select("w", "n").coalesce(1).write.mode("overwrite").parquet(f"{out}/open/batch_id={batch_id}")

    q = (hours.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_slot_close(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "events*.parquet",
                      max_files: int | None = None) -> DataFrame:
    """(digest_date, part, n_events) of the slots that a stream over
    ``folder`` closes."""
    out = shared_path(spark, "slot-close")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    run_slot_close(spark, reader.parquet(folder), out, shared_path(spark, "ckpt-slot-close"))
    return spark.read.schema("digest_date date, part int, n_events long").parquet(f"{out}/slots")


def late_flag(digest_date_col: str = "digest_date", part_col: str = "part",
              arrival: str = "arrival_ts", grace_hours: int = 1) -> F.Column:
    """Late when the arrival is at or after the slot end plus the grace."""
    from ..functions.time import slot_bounds
    _, end = slot_bounds(digest_date_col, part_col)
    return F.col(arrival) >= end + F.make_interval(hours=F.lit(grace_hours))


def late_rows(arrivals: DataFrame) -> DataFrame:
    """T4: (digest_date, part, n_events, n_late) per slot."""
    a = arrivals.withColumn("_late", late_flag())
    return (a.groupBy(*SLOT)
            .agg(F.count("*").alias("n_events"),
                 F.sum(F.col("_late").cast("long")).alias("n_late")))
