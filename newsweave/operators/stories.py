"""Story-level aggregates and rankings over clustered articles.

Input everywhere: articles with ``digest_date, part, cid, size, label``.

* A2 ``cluster_size`` is the ``size`` column (computed in clusters.py)
* A3 ``cluster_min``: column-wise minimum per story (not one real row)
* A4 ``cluster_links``: distinct links of a story, long form (one row per
  link) so that a very large story never becomes one huge array
* W1 ``top_clusters``: top-N stories per (slot, category) with a literal cap,
  which lets Catalyst insert a partial (map-side) window group limit
* O1/O3 story order and the top-k report of one slot
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_links
from .ranking import distributed_row_number

SLOT = ["digest_date", "part"]
STORY = [*SLOT, "label"]
REPRESENTATIVE_COLUMNS = ["date", "agency", "category", "title", "short_news"]


def cluster_min(clustered: DataFrame) -> DataFrame:
    """A3: (slot, label, size, date, agency, category, title, short_news)."""
    return (clustered.groupBy(*STORY)
            .agg(F.max("size").alias("size"),
                 *[F.min(c).alias(c) for c in REPRESENTATIVE_COLUMNS]))


def coherent_representative(clustered: DataFrame) -> DataFrame:
    """Option to A3: one real member per story, the earliest (then lowest id)."""
    rep = F.min_by(F.struct(*REPRESENTATIVE_COLUMNS), F.struct("date", "index"))
    return (clustered.groupBy(*STORY).agg(F.max("size").alias("size"), rep.alias("r"))
            .select(*STORY, "size", "r.*"))


def cluster_links(clustered: DataFrame) -> DataFrame:
    """(slot, label, link) distinct, one row per link."""
    links = F.split(article_links("first_link", "agency", "index"), " ")
    return (clustered.select(*STORY, F.explode(links).alias("link"))
            .distinct())


def top_clusters(stories: DataFrame, cap: int) -> DataFrame:
    """Rank stories within (slot, category) by size desc, label asc and
    keep ``rank <= cap``. ``cap`` must be a literal for the map-side limit."""
    w = Window.partitionBy(*SLOT, "category").orderBy(F.desc("size"), F.asc("label"))
    return (stories.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= F.lit(int(cap))))


def story_order(stories: DataFrame) -> DataFrame:
    """O1: position of every story in its slot (size desc, label asc),
    numbered without a per-slot window partition."""
    return distributed_row_number(stories, SLOT, [F.desc("size"), F.asc("label")], "position")


def top_stories(stories: DataFrame, digest_date: str, part: int, k: int) -> DataFrame:
    """O3: the k largest stories of one slot (TakeOrderedAndProject)."""
    one = stories.where((F.col("digest_date") == F.lit(digest_date).cast("date"))
                        & (F.col("part") == part))
    return one.orderBy(F.desc("size"), F.asc("label")).limit(k)
