"""Fixture views over the driver tables (definitions in FIXTURES.md).

The driver tables are generic; these views give them the shape of the news
domain. Every view is a lazy DataFrame derived from the given parquet tables,
so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import digest_date, epoch_seconds, slot_bounds, slot_part
from .session import materialised, read_table

# --- fixed values -----------------------------------------------------------
# Category dimension: (ordinal, category, title, emoji).
CATEGORIES = [
    (1, "click", "clicks", "C"),
    (2, "error", "errors", "E"),
    (3, "purchase", "purchases", "P"),
    (4, "signup", "signups", "S"),
    (5, "view", "views", "V"),
]
# Default user: all categories but the second, three stories each.
DEFAULT_USER_ID = -1
DEFAULT_NEWS_AMOUNT = 3
DEFAULT_MASK = 0b11101
# Letters used to build settings requests.
REQUEST_LETTERS = "cepsv"
# Sentences of a summary, words of a headline.
SUMMARY_SENTENCES = 2
HEADLINE_WORDS = 12
# Messages per landed payload page.
PAGE_SIZE = 100
# ----------------------------------------------------------------------------

CATEGORY_NAMES = [c for _, c, _, _ in CATEGORIES]


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CATEGORIES, "ordinal int, category string, title string, emoji string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document, dated and categorised by the event ``doc_id *
    5``: (agency, index, date, category, first_link, raw_news)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _dated(docs, spark, sf_dir, F.col("text").alias("raw_news"))


def _dated(docs: DataFrame, spark: SparkSession, sf_dir: str, *more: F.Column) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    link = (F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("https://ex.org/"), (F.col("doc_id") % 50).cast("string"))))
    return docs.join(ev, ev["event_id"] == docs["doc_id"] * 5).select(
        F.col("source").alias("agency"), F.col("doc_id").alias("index"), F.col("ts").alias("date"),
        F.col("event_type").alias("category"), link.alias("first_link"), *more)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News table: the posts with their headline as ``title`` and their summary
    as ``short_news`` (both read the whole text; '' for a text without words)
    and the slot columns. Written once per input, partitioned by
    ``digest_date`` and without the texts; every article-side query reads it."""
    from .operators.summarise import summaries

    def build() -> DataFrame:
        docs = read_table(spark, sf_dir, "documents")
        short = summaries(docs, SUMMARY_SENTENCES, HEADLINE_WORDS)
        found = docs.select("doc_id", "source").join(short, "doc_id", "left")
        dated = with_slot(_dated(found, spark, sf_dir, F.coalesce("headline", F.lit("")).alias("title"),
                                 F.coalesce("summary", F.lit("")).alias("short_news")))
        return dated.repartition("digest_date")

    return materialised(spark, sf_dir, "articles", ["documents", "events"], build, ["digest_date"])


def stored_before(spark: SparkSession, sf_dir: str) -> F.Column:
    """Incoming/stored split of the incremental-ingest fixture: the middle of
    the articles' time range (one scalar), null without articles."""
    lo, hi = articles(spark, sf_dir).agg(F.min("date"), F.max("date")).first()
    cut = None if lo is None else (lo + (hi - lo) // 2).isoformat(" ")
    return F.lit(cut).cast("timestamp_ntz")


def with_slot(df: DataFrame, ts: str = "date") -> DataFrame:
    """Adds ``digest_date`` and ``part``."""
    return df.withColumns({"digest_date": digest_date(ts), "part": slot_part(ts)})


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-written user settings, wide form (one flag per category)."""
    o = read_table(spark, sf_dir, "orders")
    mask = (1 + F.col("o_orderkey") % 31).cast("int")
    flags = {c: ((mask.bitwiseAND(1 << (i - 1))) > 0) for i, c, _, _ in CATEGORIES}
    return o.select(F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("updated_at"),
                    F.col("o_orderkey").alias("seq"),
                    (F.col("o_orderstatus") != "F").alias("is_subscribed"),
                    (1 + F.col("o_orderkey") % 5).cast("int").alias("news_amount"),
                    *[v.alias(k) for k, v in flags.items()])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return (c.where(F.col("c_custkey") % 5 != 4)
            .select(F.col("c_custkey").alias("user_id"),
                    F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("nickname"),
                    F.col("c_name").alias("first_name"),
                    F.col("c_mktsegment").alias("last_name")))


def default_settings(spark: SparkSession) -> DataFrame:
    """One-row default user in the wide settings form."""
    flags = {c: bool(DEFAULT_MASK & (1 << (i - 1))) for i, c, _, _ in CATEGORIES}
    cols = "user_id bigint, is_subscribed boolean, news_amount int, " + \
        ", ".join(f"{c} boolean" for c in flags)
    return spark.createDataFrame(
        [(DEFAULT_USER_ID, False, DEFAULT_NEWS_AMOUNT, *flags.values())], cols)


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source registry; a source is active when its number is even."""
    d = read_table(spark, sf_dir, "documents").select(F.col("source").alias("agency")).distinct()
    num = F.regexp_extract("agency", r"(\d+)$", 1).cast("int")
    return d.withColumn("is_active", (num % 2) == 0)


def message_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel payloads: per agency and page of ``PAGE_SIZE`` ids, a JSON object
    with ``messages[]`` of ``{id, date (epoch s), message}``. Pages bound the
    size of every payload, so no group grows with the data."""
    a = posts(spark, sf_dir)
    msg = F.struct(F.col("index").alias("id"),
                   epoch_seconds("date").alias("date"),
                   F.col("raw_news").alias("message"))
    return (a.groupBy(F.col("agency").alias("channel"),
                      F.floor(F.col("index") / PAGE_SIZE).alias("page"))
            .agg(F.sort_array(F.collect_list(msg)).alias("messages"))
            .select("channel", "page", F.to_json(F.struct("messages")).alias("payload")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests derived from events (see FIXTURES.md)."""
    e = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).try_cast("int")
    letter = lambda pos: F.substring(F.lit(REQUEST_LETTERS), pos, 1)
    text = (F.when(F.col("event_type") == "view",
                   F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd"))
                    .otherwise(F.date_format("ts", "yyyy-M-d")))
            .when(F.col("event_type") == "click",
                  F.concat((1 + k % 5).cast("string"), F.lit(" "), (1 + k % 7).cast("string")))
            .when(F.col("event_type") == "signup",
                  F.concat(F.upper(letter(1 + k % 5)), letter(1 + F.floor(k / 5).cast("int") % 5),
                           F.lit(" "), (1 + k % 4).cast("string")))
            .when(F.col("event_type") == "purchase", F.substring(F.lit(REQUEST_LETTERS), 1 + k % 4, 2))
            .otherwise(F.lit("?!")))
    return e.select(F.col("event_id").alias("request_id"), "user_id",
                    F.col("ts").alias("sent_at"), text.alias("text"))


def digest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests sent, one per view event: the slot of the send time, or for
    every second event the whole day (part 0)."""
    e = read_table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    whole = F.col("event_id") % 2 == 0
    return e.select("user_id", F.col("ts").alias("sent_at"),
                    F.when(whole, F.to_date("ts")).otherwise(digest_date("ts")).alias("digest_date"),
                    F.when(whole, F.lit(0)).otherwise(slot_part("ts")).alias("part"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a delayed arrival time; late when it is at or after the
    slot end plus one hour."""
    e = read_table(spark, sf_dir, "events")
    e = e.withColumns({"digest_date": digest_date("ts"), "part": slot_part("ts"),
                       "arrival_ts": F.col("ts") + F.make_interval(mins=(F.col("event_id") % 7).cast("int") * 30)})
    _, end = slot_bounds("digest_date", "part")
    return e.withColumn("is_late", F.col("arrival_ts") >= end + F.expr("INTERVAL 1 HOUR"))
