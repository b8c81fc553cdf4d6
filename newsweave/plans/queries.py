"""Registered queries: one per operator of the inventory, each ``(spark,
sf_dir) -> DataFrame`` over the driver tables (or data Spark derives from
them). Output columns are plain scalars with the same names as the DuckDB
oracle (plans/oracle.py): dates and times as text, arrays joined to text,
floats rounded to 6 decimals, counters as bigint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import requests as rq
from ..functions import text as tx
from ..functions import time as tm
from ..operators import categories, classify, digest, stories, summarise, users, vectors
from ..session import checkpoint, read_table, shared_path
from ..sources import messages as msg
from ..sources import sinks
from ..streaming import ingest as sing
from ..streaming import late as slate
from ..streaming import slots as sslots
from . import pipeline as pl

SLOT = ["digest_date", "part"]
# --- query parameters -------------------------------------------------------
SCAN_START, SCAN_END = "2024-01-10 07:00:00", "2024-01-12 12:00:00"
RANGE_DAY = "2024-01-10"
TODAY = "2024-01-25"
TOP_SLOT = ("2024-01-10", 2)
TOP_K = 10
SNAPSHOT_DAY = "2024-01-31"
SUMMARY_SENTENCES = fx.SUMMARY_SENTENCES
HEADLINE_WORDS = fx.HEADLINE_WORDS
# ----------------------------------------------------------------------------


def _ts(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz").cast("string")


def _d(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("date").cast("string")


def _slot(df: DataFrame) -> list[Column]:
    return [_d("digest_date").alias("digest_date"), F.col("part").cast("int").alias("part")]


def _stored(spark, d) -> DataFrame:
    return fx.articles(spark, d).where(F.col("date") < fx.stored_before(spark, d))


def _model(spark, d) -> classify.NaiveBayes:
    return classify.train_nb(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


# --- sources and sinks -------------------------------------------------------

def q_scan_messages(spark: SparkSession, d: str) -> DataFrame:
    path = msg.land_payloads(fx.message_pages(spark, d), shared_path(spark, "landing"))
    m = msg.read_messages(spark, path)
    return m.select("agency", "index", _ts("date").alias("date"), "message")


def q_scan_bad_messages(spark, d):
    """Landed lines that give no posts: of the channels' pages, every third is
    cut off and every third has no list."""
    pages = fx.message_pages(spark, d)
    at = F.col("page").cast("string")
    kind = F.pmod("page", F.lit(3))
    payload = (F.when(kind == 0, F.concat(F.lit('{"page": '), at, F.lit(', "messages": [{"id": 1')))
               .when(kind == 1, F.concat(F.lit('{"page": '), at, F.lit("}"))).otherwise(F.col("payload")))
    path = msg.land_raw(pages.select("channel", payload.alias("payload")), shared_path(spark, "landing"))
    return msg.bad_records(spark, path).select(F.col("channel").alias("agency"), "reason", "record")


def q_scan_range(spark, d):
    a = fx.articles(spark, d)
    start, end = (F.lit(x).cast("timestamp_ntz") for x in (SCAN_START, SCAN_END))
    # the slot dates of the range prune partitions, the range itself is pushed to the scan
    r = a.where((F.col("digest_date") >= tm.digest_date(start)) & (F.col("digest_date") <= tm.digest_date(end))
                & (F.col("date") >= start) & (F.col("date") < end))
    return r.select("agency", "index", _ts("date").alias("date"))


def q_active_sources(spark, d):
    a = msg.active_sources(fx.articles(spark, d), fx.agencies(spark, d))
    return a.select("agency", "index")


def q_sink_articles(spark, d):
    path = shared_path(spark, "news")
    rows = fx.articles(spark, d).select("agency", "index", "date", "title", "category", *SLOT)
    early = F.col("date") < fx.stored_before(spark, d)
    sinks.append_articles(rows.where(early), path, "first")
    for _ in range(2):  # the second job runs again, as after a failure behind its write
        sinks.append_articles(rows.where(~early), path, "second")
    back = spark.read.parquet(path)
    return back.select("agency", "index", *_slot(back), "category", "title")


def q_sink_user_log(spark, d):
    path = shared_path(spark, "user_settings")
    log = fx.settings_log(spark, d)
    sinks.append_user_log(log, path)
    applied = users.settings_apply(fx.requests(spark, d), log, fx.categories(spark)).drop("request_id")
    sinks.append_user_log(applied.select(*log.columns), path)
    cur = users.latest_settings(spark.read.parquet(path))
    return cur.select("user_id", "seq", "is_subscribed", "news_amount",
                      F.array_join(users.flags_to_categories(), ",").alias("categories"))


def q_snapshot(spark, d):
    root = shared_path(spark, "backups")
    a = fx.articles(spark, d).select("agency", "index", "category")
    sinks.snapshot(a, root, SNAPSHOT_DAY)
    sinks.snapshot(a, root, SNAPSHOT_DAY)  # idempotent: the same day again
    snap = sinks.read_snapshot(spark, root)
    return (snap.groupBy(_d("snapshot_date").alias("snapshot_date"), "agency")
            .agg(F.count("*").alias("n_articles")))


def q_ingest_metrics(spark, d):
    new = msg.incremental(fx.posts(spark, d), _stored(spark, d), body="raw_news")
    m = sinks.ingest_metrics(new)
    return m.select("agency", "n_articles", _ts("first_date").alias("first_date"),
                    _ts("last_date").alias("last_date"))


# --- filters -----------------------------------------------------------------

def q_incremental_filter(spark, d):
    new = msg.incremental(fx.posts(spark, d), _stored(spark, d), body="raw_news")
    return new.select("agency", "index")


def q_drop_empty(spark, d):
    docs = read_table(spark, d, "documents")
    c = docs.select("doc_id", tx.clean_text("text").alias("t"))
    return c.where(F.length("t") > 0).select("doc_id", F.length("t").cast("bigint").alias("n_chars"))


def q_slot_range(spark, d):
    from ..operators import slots as sl
    return sl.slot_range(fx.articles(spark, d).select("index", "date"), RANGE_DAY).select("part", "index")


def q_subscribed_users(spark, d):
    s = pl.subscriber_settings(spark, d)
    return s.select("user_id", "news_amount", pl.joined("categories").alias("categories"))


def q_date_guard(spark, d):
    r = fx.requests(spark, d).where(rq.classify_request("text") == "digest")
    day = tm.parse_date("text")
    return r.select("request_id", _d(day).alias("req_date"),
                    tm.date_guard(day, TODAY).alias("is_valid"))


def q_slot_fallback(spark, d):
    from ..operators import slots as sl
    present = fx.articles(spark, d).select(*SLOT).distinct()
    fb = sl.slot_fallback(present)
    return fb.select(_d("digest_date").alias("digest_date"), F.col("part").cast("int").alias("part"),
                     _d("src_date").alias("src_date"), F.col("src_part").cast("int").alias("src_part"))


def q_settings_unpivot(spark, d):
    return users.settings_unpivot(fx.settings_log(spark, d))


def q_settings_apply(spark, d):
    a = users.settings_apply(fx.requests(spark, d), fx.settings_log(spark, d), fx.categories(spark))
    return a.select("request_id", "user_id", "news_amount",
                    F.array_join(users.flags_to_categories(), ",").alias("categories"))


# --- joins -------------------------------------------------------------------

def q_category_lookup(spark, d):
    a = fx.articles(spark, d).select("index", "category")
    return digest.category_lookup(a, fx.categories(spark)).select(
        "index", "category", "category_title", "emoji")


def q_semi_subscribed(spark, d):
    r = users.semi_subscribed(fx.requests(spark, d), fx.settings_log(spark, d))
    return r.select("request_id", "user_id")


def q_subscribe_actions(spark, d):
    cmds = (read_table(spark, d, "events").where(F.col("event_type") == "signup")
            .select(F.col("event_id").alias("request_id"), "user_id"))
    return users.subscribe_actions(cmds, fx.settings_log(spark, d)).select("request_id", "user_id", "action")


def q_settings_or_default(spark, d):
    people = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    s = users.settings_or_default(people, fx.users(spark, d), fx.settings_log(spark, d),
                                  fx.default_settings(spark))
    return s.select("user_id", "source", "is_subscribed", "news_amount",
                    pl.joined("categories").alias("categories"))


def q_token_vectors(spark, d):
    toks = vectors.title_tokens(fx.articles(spark, d), [])
    vocab = vectors.vocabulary(toks, read_table(spark, d, "embeddings").count())
    tv = vectors.token_vectors(toks, vocab)
    return tv.select("index", F.col("pos").cast("int").alias("pos"), "word", "vec_id")


def q_title_copies(spark, d):
    """Members of the nodes of the pair join: copies of one title vector."""
    from ..operators import clusters
    m, _ = clusters.view_nodes(pl.view_articles(spark, d), pl.headline_vectors(spark, d))
    return m.select(*_slot(m), "index", "node")


def q_similar_pairs(spark, d):
    p = pl.pairs(spark, d)
    return p.select(*_slot(p), "a", "b", "d")


def _ranked(spark, d, cap: int | None = None) -> DataFrame:
    st = pl.story_table(spark, d)
    if cap is None:
        cap = digest.max_amount(pl.subscriber_settings(spark, d))
    return stories.top_clusters(st, cap)


def q_digest_lines(spark, d):
    st = pl.story_table(spark, d)
    lines = digest.digest_lines(st, pl.subscriber_settings(spark, d), pl.slot_views(spark, d))
    return lines.select("user_id", *_slot(lines), "category_no", "category", "rank", "label", "title")


def _coordinate_requests(spark, d) -> DataFrame:
    r = fx.requests(spark, d).where(rq.classify_request("text") == "coordinates")
    num, label = rq.parse_coordinates("text")
    r = r.select("request_id", "user_id", "sent_at", num.alias("category_no"), label.alias("label"))
    last = users.asof_digest(r.select("request_id", "user_id", "sent_at"), fx.digest_log(spark, d))
    # the last digest may be a slot's or a whole day's
    return (r.join(last.select("request_id", *SLOT), "request_id")
            .where(F.col("digest_date").isNotNull()))


def _resolved(spark, d) -> DataFrame:
    req = _coordinate_requests(spark, d)
    return digest.drilldown(req, pl.subscriber_settings(spark, d), _ranked(spark, d), pl.read_views(spark, d))


def q_drilldown(spark, d):
    r = _resolved(spark, d)
    return r.select("request_id", "user_id", *_slot(r), "category", "label", "shown_date", "title", "summary")


def q_letter_match(spark, d):
    r = fx.requests(spark, d).where(rq.classify_request("text") == "settings")
    letters, _ = rq.parse_settings("text")
    chars = r.select("request_id", F.posexplode(F.split(letters, "")).alias("pos", "letter"))
    m = users.letter_match(chars, fx.categories(spark))
    return m.select("request_id", F.col("pos").cast("int").alias("pos"), "letter", "category")


def q_asof_digest(spark, d):
    r = (fx.requests(spark, d).where(rq.classify_request("text") == "coordinates")
         .select("request_id", "user_id", "sent_at"))
    a = users.asof_digest(r, fx.digest_log(spark, d))
    return a.select("request_id", "user_id", _ts("digest_sent_at").alias("digest_sent_at"),
                    *_slot(a))


# --- aggregations --------------------------------------------------------------

def q_high_water(spark, d):
    return msg.high_water(fx.articles(spark, d))


def q_cluster_size(spark, d):
    s = pl.story_articles(spark, d)
    return s.select(*_slot(s), "index", F.col("size").cast("bigint").alias("size"))


def q_cluster_min(spark, d):
    c = pl.story_table(spark, d)
    return c.select(*_slot(c), "label", F.col("size").cast("bigint").alias("size"),
                    _ts("date").alias("date"), "agency", "category", "title", "short_news")


def q_cluster_links(spark, d):
    c = stories.cluster_links(pl.story_articles(spark, d))
    return c.select(*_slot(c), "label", "link")


def q_article_vectors(spark, d):
    v = pl.headline_vectors(spark, d)
    return v.select("index", F.posexplode("vec").alias("dim", "value")).select(
        "index", F.col("dim").cast("int").alias("dim"), (F.floor(F.col("value") * 1e6 + 0.50003719) / 1e6).alias("value"))


def q_story_clusters(spark, d):
    s = pl.story_articles(spark, d)
    return s.select(*_slot(s), "index", "cid", F.col("size").cast("bigint").alias("size"), "label")


def q_story_clusters_distributed(spark, d):
    """The same stories by the distributed path alone."""
    s = pl.build_story_articles(spark, d, local_max=0)
    return s.select(*_slot(s), "index", "cid", F.col("size").cast("bigint").alias("size"), "label")


def q_story_representative(spark, d):
    c = stories.coherent_representative(pl.story_articles(spark, d))
    return c.select(*_slot(c), "label", F.col("size").cast("bigint").alias("size"), _ts("date").alias("date"),
                    "agency", "category", "title", "short_news")


def q_digest_text(spark, d):
    t = digest.digest_text(pl.story_table(spark, d), pl.subscriber_settings(spark, d), fx.users(spark, d),
                           fx.categories(spark), pl.slot_views(spark, d))
    return t.select("user_id", *_slot(t), "text")


def _day_lines(spark, d) -> DataFrame:
    r = fx.requests(spark, d).where(rq.classify_request("text") == "digest")
    r = r.select("request_id", "user_id", tm.parse_date("text").alias("digest_date"))
    # read for the users and for their lines: the commands are parsed once
    r = checkpoint(r.where(tm.date_guard(F.col("digest_date"), TODAY)), "day-requests")
    mine = users.settings_or_default(r.select("user_id").distinct(), fx.users(spark, d), fx.settings_log(spark, d),
                                     fx.default_settings(spark))
    return digest.day_digest(r, mine, pl.story_table(spark, d))


def q_day_digest(spark, d):
    n = _day_lines(spark, d)
    return n.select("request_id", "user_id", *_slot(n), "category_no", "category", "rank", "label", "title")


def q_day_digest_text(spark, d):
    """The texts, appended to the log of digests sent and read back."""
    t = digest.day_digest_text(_day_lines(spark, d), fx.users(spark, d), fx.categories(spark))
    path = shared_path(spark, "user_digest")
    sinks.append_user_log(t, path)
    back = spark.read.parquet(path)
    return back.select("request_id", "user_id", *_slot(back), "text")


def q_user_events(spark, d):
    """Settings rows that commands append, read back from the log."""
    e = read_table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    commands = e.select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("sent_at"),
                        F.when(F.col("event_type") == "signup", "subscribe").otherwise("unsubscribe").alias("command"))
    rows = users.user_events(commands, fx.settings_log(spark, d), fx.default_settings(spark))
    path = shared_path(spark, "user_settings")
    sinks.append_user_log(rows, path)
    back = spark.read.parquet(path)
    return back.select("seq", "action", "user_id", "is_subscribed", "news_amount",
                       F.array_join(users.flags_to_categories(), ",").alias("categories"))


def q_location_log(spark, d):
    """Locations sent by users, appended as typed structs and read back."""
    e = read_table(spark, d, "events").where(F.col("event_type") == "click")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).try_cast("int")
    place = rq.location_struct(k % 180 - 90, (F.col("event_id") % 3600).cast("double") / 10 - 180)
    path = shared_path(spark, "users_coord")
    sinks.append_user_log(e.select("user_id", F.col("ts").alias("sent_at"), place.alias("location")), path)
    back = spark.read.parquet(path)
    return back.select("user_id", _ts("sent_at").alias("sent_at"), F.col("location.lat").alias("lat"),
                       F.col("location.lon").alias("lon"))


def q_drilldown_links(spark, d):
    links = stories.cluster_links(pl.story_articles(spark, d))
    r = digest.drilldown_links(_resolved(spark, d), links)
    return r.select("request_id", *_slot(r), "label", "link")


# --- windows, sorts ------------------------------------------------------------

def q_top_clusters(spark, d):
    t = _ranked(spark, d)
    return t.select(*_slot(t), "category", "rank", "label", F.col("size").cast("bigint").alias("size"))


def q_category_numbers(spark, d):
    c = digest.category_numbers(pl.subscriber_settings(spark, d))
    return c.select("user_id", "category_no", "category")


def q_story_labels(spark, d):
    s = pl.story_articles(spark, d)
    return s.select(*_slot(s), "index", "label")


def q_latest_settings(spark, d):
    cur = users.latest_settings(fx.settings_log(spark, d))
    return cur.select("user_id", "seq", "is_subscribed", "news_amount",
                      F.array_join(users.flags_to_categories(), ",").alias("categories"))


def q_story_order(spark, d):
    o = stories.story_order(pl.story_table(spark, d))
    return o.select(*_slot(o), "label", "position", F.col("size").cast("bigint").alias("size"))


def q_top_stories(spark, d):
    t = stories.top_stories(pl.story_table(spark, d), TOP_SLOT[0], TOP_SLOT[1], TOP_K)
    return t.select(*_slot(t), "label", F.col("size").cast("bigint").alias("size"), "title")


# --- set operations --------------------------------------------------------------

def q_merge_articles(spark, d):
    # titles differ on both sides, so a row shows which side it is from
    a = fx.articles(spark, d).select("agency", "index", F.concat(F.lit("new: "), "title").alias("title"))
    m = msg.merge_articles(_stored(spark, d).select("agency", "index", "title"), a)
    return m.select("agency", "index", "title")


# --- scalar functions --------------------------------------------------------------

def q_first_link(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", tx.first_link("html").alias("first_link"))


def q_html_text(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", tx.html_to_text("html").alias("text"))


def q_clean_text(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", tx.clean_text("html").alias("text"))


def q_strip_labels(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", tx.strip_labels(tx.flatten_space("text")).alias("text"))


def q_article_links(spark, d):
    a = fx.articles(spark, d)
    return a.select("agency", "index", tx.article_links("first_link", "agency", "index").alias("links"))


def q_clean_words(spark, d):
    a = fx.articles(spark, d)
    t = a.select("index", F.posexplode(tx.tokenise("title")).alias("pos", "tok"))
    return t.select("index", F.col("pos").cast("int").alias("pos"), "tok", tx.clean_word("tok").alias("word"))


def q_label_suffix(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", tx.label_suffix(F.concat(F.lit("__label__"), "event_type")).alias("category"))


def q_epoch_time(spark, d):
    a = fx.articles(spark, d)
    secs = tm.epoch_seconds("date")
    return a.select("index", secs.alias("epoch"),
                    _ts(tm.epoch_to_time(secs)).alias("utc_time"),
                    _ts(tm.epoch_to_time(secs, "Europe/Moscow")).alias("msk_time"))


def q_parse_date(spark, d):
    r = fx.requests(spark, d)
    return r.select("request_id", _d(tm.parse_date("text")).alias("parsed"))


def q_display_date(spark, d):
    a = fx.articles(spark, d)
    return a.select("index", tm.display_date(tm.cut_fraction("date")).alias("shown"),
                    tm.display_day(tm.digest_date("date")).alias("shown_day"))


def q_request_kind(spark, d):
    r = fx.requests(spark, d)
    num, label = rq.parse_coordinates("text")
    letters, amount = rq.parse_settings("text")
    return r.select("request_id", rq.classify_request("text").alias("kind"),
                    num.alias("category_no"), label.alias("label"),
                    letters.alias("letters"), amount.alias("news_amount"))


# --- text models -------------------------------------------------------------------

def q_classify_nb(spark, d):
    docs = read_table(spark, d, "documents")
    labels = read_table(spark, d, "labels")
    scored = classify.classify_nb(docs, labels)
    kept = classify.drop_not_news(scored)
    return kept.select("doc_id", "category")


def _quality_classes(spark, d) -> DataFrame:
    """A class for each pair of labels that occurs."""
    return read_table(spark, d, "labels").select("doc_id", F.concat(
        F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("class"))


def q_classify_multi(spark, d):
    return categories.classify_multi(read_table(spark, d, "documents"), _quality_classes(spark, d))


def q_classify_linear(spark, d):
    return categories.classify_linear(read_table(spark, d, "documents"), _quality_classes(spark, d))


def q_classify_lr(spark, d):
    docs = read_table(spark, d, "documents")
    labels = read_table(spark, d, "labels")
    return classify.classify_lr(docs, labels).select("doc_id", "category")


def q_summarise(spark, d):
    docs = read_table(spark, d, "documents")
    return summarise.summarise(docs, SUMMARY_SENTENCES).select("doc_id", "summary")


def q_headline(spark, d):
    docs = read_table(spark, d, "documents")
    return summarise.headline(docs, HEADLINE_WORDS).select("doc_id", "headline")


def q_score_batches(spark, d):
    docs = read_table(spark, d, "documents")
    return classify.score_batches(docs, classify.LengthModel).select("doc_id", "score")


# --- streaming -----------------------------------------------------------------------

def q_ingest_pipeline(spark, d):
    """One collection run as a batch job: active sources, posts above the
    stored high water, clean, summary, headline, class, without non-news."""
    path = msg.land_payloads(fx.message_pages(spark, d), shared_path(spark, "landing"))
    posts = sing.new_posts(msg.read_messages(spark, path), fx.agencies(spark, d), msg.high_water(_stored(spark, d)))
    a = sing.to_articles(posts, _model(spark, d), SUMMARY_SENTENCES, HEADLINE_WORDS)
    return a.select("agency", "index", _ts("date").alias("date"), *_slot(a), "title", "short_news", "first_link",
                    "category")


def q_stream_ingest(spark, d):
    out = sing.stream_ingest(spark, fx.message_pages(spark, d), _model(spark, d), fx.agencies(spark, d))
    return out.select("agency", "index", _ts("date").alias("date"), *_slot(out), "title", "short_news")


def q_stream_metrics(spark, d):
    """The live figures of an ingest run of posts above the stored high water."""
    m = sing.stream_metrics(spark, fx.message_pages(spark, d), _model(spark, d), fx.agencies(spark, d),
                            msg.high_water(_stored(spark, d)), max_files=20)
    return m.select("agency", "n_articles", "first_date", "last_date")


def q_slot_assign(spark, d):
    e = read_table(spark, d, "events")
    s = e.select("event_id", tm.digest_date("ts").alias("digest_date"), tm.slot_part("ts").alias("part"))
    return s.select("event_id", *_slot(s))


def q_stream_slots(spark, d):
    s = sslots.stream_slot_counts(spark, d.rstrip("/"), read_table(spark, d, "events").schema)
    return s.select(*_slot(s), F.col("n_events").cast("bigint").alias("n_events"))


def q_stream_slot_close(spark, d):
    s = sslots.stream_slot_close(spark, d.rstrip("/"), read_table(spark, d, "events").schema)
    return s.select(*_slot(s), F.col("n_events").cast("bigint").alias("n_events"))


def _by_arrival(rows: DataFrame) -> list[DataFrame]:
    """Three landings of nearly equal length in time, in the order of arrival."""
    rows = checkpoint(rows, "arrivals")
    lo, hi = rows.agg(F.min("arrival_ts"), F.max("arrival_ts")).first()
    if lo is None:
        return [rows]
    a, b = (F.lit((lo + (hi - lo) * k // 3).isoformat(" ")).cast("timestamp_ntz") for k in (1, 2))
    at = F.col("arrival_ts")
    return [rows.where(at < a), rows.where((at >= a) & (at < b)), rows.where(at >= b)]


def q_stream_late_counts(spark, d):
    """Events and late ones of every slot over three landings; with a delay of
    two hours, half of the late ones go beside the watermark."""
    arrivals = fx.arrivals(spark, d).select("event_id", "ts", "arrival_ts")
    s = slate.stream_late_counts(spark, _by_arrival(arrivals), "2 hours")
    return s.select(*_slot(s), "n_events", "n_late")


def q_stream_late(spark, d):
    """Stories kept up to date over three landings of articles by arrival."""
    arts = fx.articles(spark, d)
    came = fx.arrivals(spark, d).where(F.col("event_id") % 5 == 0).select(
        (F.col("event_id") / 5).cast("long").alias("index"), "arrival_ts")
    s = slate.stream_late(spark, _by_arrival(arts.join(came, "index")), read_table(spark, d, "embeddings"))
    return s.select(*_slot(s), "index", "cid", F.col("size").cast("bigint").alias("size"), "label")


def _delivered(spark, d) -> str:
    """All slots' digests delivered one hour after their slot, twice, as by a
    job that is run again."""
    t, keys = digest.digest_parts(pl.story_table(spark, d), pl.subscriber_settings(spark, d), fx.users(spark, d),
                                  fx.categories(spark), pl.slot_views(spark, d))
    log, sent_at = shared_path(spark, "user_digest"), tm.slot_bounds("digest_date", "part")[1] + F.expr("INTERVAL 1 HOUR")
    for exists in (False, True):
        sinks.deliver(spark, t, log, sent_at, exists, keys)
    return log


def q_deliver_slot(spark, d):
    back = sinks.read_deliveries(spark, _delivered(spark, d))
    return back.select("user_id", *_slot(back), _ts("sent_at").alias("sent_at"), "text")


def q_deliver_asof(spark, d):
    """The last delivered digest before each request."""
    r = (fx.requests(spark, d).where(rq.classify_request("text") == "coordinates")
         .select("request_id", "user_id", "sent_at"))
    log = sinks.read_deliveries(spark, _delivered(spark, d)).select("user_id", "sent_at", *SLOT)
    a = users.asof_digest(r, log)
    return a.select("request_id", "user_id", _ts("digest_sent_at").alias("digest_sent_at"), *_slot(a))


def q_late_rows(spark, d):
    s = sslots.late_rows(fx.arrivals(spark, d))
    return s.select(*_slot(s), "n_events", "n_late")


def q_late_refresh(spark, d):
    """Stories of the on-time articles, brought up to date after the late ones
    landed: equal to clustering all articles."""
    arts, emb = fx.articles(spark, d), read_table(spark, d, "embeddings")
    late = (fx.arrivals(spark, d).where((F.col("event_id") % 5 == 0) & F.col("is_late"))
            .select((F.col("event_id") / 5).cast("long").alias("index"))
            .join(arts.select("index"), "index", "left_semi"))
    late = checkpoint(late, "late")
    on_time = arts.join(late, "index", "left_anti")
    old_vecs = checkpoint(pl.vectors_of(on_time, emb), "old-vectors")
    old = checkpoint(pl.stories_of(pl.view_articles_of(on_time), old_vecs), "old-stories")
    s = pl.refresh_stories(old, old_vecs, arts, emb, late)
    return s.select(*_slot(s), "index", "cid", F.col("size").cast("bigint").alias("size"), "label")


def _waves(spark, d) -> list[DataFrame]:
    """Three landings: pages without the oldest third of the ids, the same
    again with all newer ones, then everything, old unseen posts included."""
    pages = checkpoint(fx.message_pages(spark, d), "pages")  # each landing reads them
    lo, hi = fx.posts(spark, d).agg(F.min("index"), F.max("index")).first()
    step = max(1, ((hi or 0) - (lo or 0)) // 3)

    def kept(name: str, low: int, high: int) -> DataFrame:
        part = F.filter(F.from_json("payload", msg.PAYLOAD)["messages"],
                        lambda m: (m["id"] >= low) & (m["id"] < high))
        return pages.select("channel", F.concat(F.lit(f"{name}-"), F.col("page").cast("string")).alias("page"),
                            F.to_json(F.struct(part.alias("messages"))).alias("payload"))

    first = lo or 0
    return [kept("a", first + step, first + 2 * step), kept("b", first + step, (hi or 0) + 1),
            kept("c", first, (hi or 0) + 1)]


def q_stream_dedup(spark, d):
    out = sing.stream_dedup(spark, _waves(spark, d))
    return out.select("agency", "index", _ts("date").alias("date"))


def q_stream_high_water(spark, d):
    out = sing.stream_high_water(spark, fx.message_pages(spark, d))
    return out.select("agency", "high_water")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
