"""Connected components of a link table by large-star and small-star rounds
(Kiveris et al., 2014): every round is two aggregations and joins over the
links, written to the shared folder, until the links form stars. The number of
rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(pairs: DataFrame) -> DataFrame:
    """u, v with the least v of every u: a hub's pairs are split over tasks,
    its minimum is summed before the shuffle."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(low, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of ``links``; root is the least node of its
    component."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs = written(pairs, "links", "snappy")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")) \
            .where("u > v").distinct()
        star = _stars(large)
        small = star.select("u", F.col("m").alias("v")) \
            .unionByName(star.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        pairs = written(small, "links", "snappy")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
