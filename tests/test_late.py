"""T4: recomputing only the views touched by late articles equals a full
rebuild over all articles."""

from newsweave.plans import pipeline as pl
from newsweave.plans import queries as Q

from conftest import SF_SMALL

COLS = ["digest_date", "part", "index", "cid", "size", "label"]


def test_refresh_touched_views_equals_full_rebuild(spark):
    got = sorted(tuple(r) for r in Q.q_late_refresh(spark, SF_SMALL).select(*COLS).collect())
    full = sorted(tuple(r) for r in Q.q_story_clusters(spark, SF_SMALL).select(*COLS).collect())
    assert got == full and len(got) > 0
    assert pl.story_articles(spark, SF_SMALL).count() == len(got)


def test_refreshed_vectors_are_made_once(spark):
    """Members, nodes and the next batch read written vectors, not their joins."""
    from pyspark.sql import functions as F

    from newsweave import fixtures as fx
    arts, emb = fx.articles(spark, SF_SMALL), spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    late = arts.where(F.col("index") % 9 == 0).select("index")
    on_time = arts.join(late, "index", "left_anti")
    old_vecs = pl.vectors_of(on_time, emb)
    old = pl.stories_of(pl.view_articles_of(on_time), old_vecs)
    stories, vecs = pl.refreshed(old, old_vecs, arts, emb, late)
    assert "Join" not in vecs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, stories.select(*COLS).collect())) == sorted(map(tuple, pl.story_articles(spark, SF_SMALL).select(*COLS).collect()))
    assert vecs.count() == pl.headline_vectors(spark, SF_SMALL).count()
