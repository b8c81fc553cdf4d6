"""``row_number() over (partition by P order by O)`` without one window
partition per key.

A window needs all rows of a key in one task; with one key holding a third of
all rows that task sorts a third of the data alone. Here the rows are sorted
globally (range partitioning spreads even a single key over many tasks), the
sorted table is written once, and the number is

    global position = rows in earlier partitions + position in the partition
    row_number      = global position - first global position of the key + 1

The per-partition counts are one row per partition; the first position per
key is a partial (map-side) aggregate. The position inside a partition comes
from ``monotonically_increasing_id`` (partition id in the upper 31 bits,
record number in the lower 33 bits, as documented).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint

_LOW_BITS = 33


def distributed_row_number(df: DataFrame, partition_by: list[str], order_by: list[Column],
                           name: str = "row_number") -> DataFrame:
    """``df`` with an extra long column ``name``; ``order_by`` must make the
    order total within each key (ties change nothing only if broken)."""
    ordered = df.orderBy(*[F.col(c) for c in partition_by], *order_by)
    mid = F.monotonically_increasing_id()
    tagged = ordered.select("*", F.spark_partition_id().alias("_pid"),
                            (mid - F.shiftleft(F.spark_partition_id().cast("long"), _LOW_BITS)).alias("_pos"))
    tagged = checkpoint(tagged, "ranked")  # one fixed order for both uses below
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    g = tagged.join(F.broadcast(offsets), "_pid").withColumn("_g", F.col("_off") + F.col("_pos"))
    first = g.groupBy(*partition_by).agg(F.min("_g").alias("_g0"))
    return (g.join(broadcast_if_small(first), partition_by)
            .withColumn(name, (F.col("_g") - F.col("_g0") + 1).cast("long"))
            .drop("_pid", "_pos", "_off", "_g", "_g0"))
