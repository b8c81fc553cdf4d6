"""Shared plan pieces: articles -> headline vectors -> complete-linkage
stories per view (a slot, or a whole day as part 0). The article table
(``fixtures.articles``) and the stories are written once per input into the
shared checkpoint folder; every digest, drill-down and ranking joins to the
written stories instead of reclustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clusters, stories, users, vectors
from ..operators import slots as slot_ops
from ..session import broadcast_if_small, checkpoint, materialised, read_table

SLOT = ["digest_date", "part"]
STORY_SOURCES = ["documents", "events", "embeddings"]


def views_of(slotted: DataFrame) -> DataFrame:
    """(digest_date, part, src_date, src_part) for every slot of the grid:
    the slot itself, or the previous calendar day (part 0) when the slot has
    no article (F9). One row per slot."""
    return slot_ops.slot_fallback(slotted.select(*SLOT).distinct())


def day_views_of(slotted: DataFrame) -> DataFrame:
    """The whole days (part 0) that have articles; each reads itself."""
    day = slotted.select(F.to_date("date").alias("digest_date")).distinct()
    return day.select("digest_date", F.lit(0).alias("part"), F.col("digest_date").alias("src_date"),
                      F.lit(0).alias("src_part"))


def view_articles_of(slotted: DataFrame) -> DataFrame:
    """Articles of every story view: each article in its own slot and in its
    calendar day (part 0), which on-demand digests and the fallback of empty
    slots read."""
    return slotted.unionByName(slotted.withColumns({"digest_date": F.to_date("date"), "part": F.lit(0)}))


def vectors_of(slotted: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(index, bag, vec): one mean title vector per article."""
    return vectors.title_vectors(slotted, embeddings)


def stories_of(view_arts: DataFrame, vecs: DataFrame, local_max: int = clusters.LOCAL_MAX_NODES) -> DataFrame:
    """Cluster and label the given view articles: J6 -> A6 -> A2 -> W3
    (bounded views in one task each, larger ones fully distributed)."""
    labelled = clusters.view_stories(view_arts.select(*SLOT, "index"), vecs, local_max=local_max)
    return view_arts.join(labelled, [*SLOT, "index"])


def slot_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views_of(fx.articles(spark, sf_dir))


def read_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view that a digest can name: slots and whole days."""
    arts = fx.articles(spark, sf_dir)
    return views_of(arts).unionByName(day_views_of(arts))


def view_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_articles_of(fx.articles(spark, sf_dir))


def headline_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "vectors", STORY_SOURCES, lambda: vectors_of(
        fx.articles(spark, sf_dir), read_table(spark, sf_dir, "embeddings")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct title vectors of every view, with their number of copies."""
    return clusters.view_nodes(view_articles(spark, sf_dir), headline_vectors(spark, sf_dir))[1]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 inside every story view."""
    return vectors.similar_pairs(nodes(spark, sf_dir).where(F.col("vec").isNotNull()))


def build_story_articles(spark: SparkSession, sf_dir: str, local_max: int = clusters.LOCAL_MAX_NODES) -> DataFrame:
    return stories_of(view_articles(spark, sf_dir), headline_vectors(spark, sf_dir), local_max)


def refresh_stories(old_stories: DataFrame, old_vecs: DataFrame, slotted_all: DataFrame,
                    embeddings: DataFrame, late: DataFrame) -> DataFrame:
    """The stories of ``refreshed``."""
    return refreshed(old_stories, old_vecs, slotted_all, embeddings, late)[0]


def refreshed(old_stories: DataFrame, old_vecs: DataFrame, slotted_all: DataFrame,
              embeddings: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T4: after late articles (``late``: their ``index``) landed in the
    table, recompute only the story views they touch and keep the rest.

    The vocabulary is derived from all titles, so a late title can bring an
    old word over its limit. Titles are looked at again only if they are late
    or hold such a word; all other bags and vectors are the old ones. Touched
    views hold a late article or one whose bag changed. The stories and vectors
    equal those of a full rebuild over all articles."""
    toks = checkpoint(vectors.title_tokens(slotted_all, []), "tokens")
    late = checkpoint(late.select("index").distinct(), "late")
    marked = toks.join(broadcast_if_small(late.withColumn("late", F.lit(True))), "index", "left")
    # words of late titles whose state differs with and without them
    per_word = (marked.where("word <> ''").select("word", "index", F.coalesce("late", F.lit(False)).alias("late"))
                .distinct().groupBy("word").agg(F.count("*").alias("n"), F.sum((~F.col("late")).cast("int")).alias("m")))
    moved_words = per_word.where("n >= 2 and m < 2").select("word")
    again = (toks.join(moved_words, "word", "left_semi").select("index")
             .unionByName(late.select("index")).distinct())
    again = checkpoint(again, "again")
    vocab = per_word.where("n >= 2").select("word", vectors.vector_id(F.col("word"), embeddings.count()).alias("vec_id"))
    bags = checkpoint(vectors.title_bags(vectors.token_vectors(toks.join(again, "index", "left_semi"), vocab)), "bags")
    fresh_vecs = bags.join(vectors.bag_vectors(bags, embeddings), "bag").select("index", "bag", "vec")
    # read for members, for nodes and by the caller: made once
    vecs = checkpoint(old_vecs.join(again, "index", "left_anti").unionByName(fresh_vecs), "vectors")
    view_arts = view_articles_of(slotted_all)
    touched = view_arts.join(again, "index", "left_semi").select(*SLOT).distinct()
    touched = checkpoint(touched, "touched")
    keep = old_stories.join(touched, SLOT, "left_anti")
    fresh = stories_of(view_arts.join(touched, SLOT, "left_semi"), vecs)
    return keep.unionByName(fresh.select(*keep.columns)), vecs


def story_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with ``cid, size, label`` (written once per input)."""
    return materialised(spark, sf_dir, "stories", STORY_SOURCES, lambda: build_story_articles(spark, sf_dir))


def story_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (slot, label): size and column-wise minimum (A3); written
    once, so size checks see its real size."""
    return materialised(spark, sf_dir, "story", STORY_SOURCES,
                        lambda: stories.cluster_min(story_articles(spark, sf_dir)))


def subscriber_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers with amount and categories, written once per log."""
    return materialised(spark, sf_dir, "subscribers", ["orders"], lambda: users.subscribed_users(
        fx.settings_log(spark, sf_dir)).withColumn("categories", users.flags_to_categories())
        .select("user_id", "news_amount", "categories"))


def joined(arr_col: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(arr_col), sep)
