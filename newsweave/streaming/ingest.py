"""T1 incremental ingest, T5 keyed dedupe, T6 per-source high water, S7 live
metrics, as Structured Streaming queries over landed payload files.

Every query uses a checkpoint in the shared checkpoint folder and
``Trigger.AvailableNow``: each run processes exactly the files that arrived
since the last run, then stops (the scheduled collection runs). The
micro-batch body reuses the batch functions via ``foreachBatch``, so batch
and stream give the same rows.

Exactly once: posts pass a keyed state in RocksDB (``dropDuplicates`` without
a watermark), which forgets nothing, so a post is new if its (agency, index)
never came before, however old it is; nothing stored is read for that. A
micro-batch writes the folder ``run_id=<query>/batch_id=<batch>`` with
overwrite; the query's id lives in its checkpoint. A batch that is retried
replaces its own rows, a restart goes on behind them, and a new checkpoint
over an existing table writes beside what is there. Such a run alone also
leaves out the keys that the runs before it stored.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import with_slot
from ..functions.text import clean_text, first_link
from ..operators.classify import NaiveBayes, drop_not_news, score_nb
from ..operators.summarise import summaries
from ..session import broadcast_if_small, checkpoint, shared_path
from ..sources import messages as msg

POST = ["agency", "index"]


def land(pages: DataFrame, path: str) -> str:
    """Write landed payload pages (one folder per channel)."""
    return msg.land_payloads(pages, path)


def message_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Posts of all landed files; ``max_files`` bounds a micro-batch only if
    the caller asks for it."""
    reader = msg.landed_reader(spark.readStream)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return msg.messages_from_payload(reader.json(landing))


def new_posts(m: DataFrame, registry: DataFrame, high_water: DataFrame | None) -> DataFrame:
    """S3 + F1: posts of active sources, newer than the newest stored one."""
    m = msg.active_sources(m, registry)
    if high_water is None:
        return m
    j = m.join(broadcast_if_small(high_water), "agency", "left")
    return j.where(F.col("index") > F.coalesce("high_water", F.lit(0))).drop("high_water")


def to_articles(m: DataFrame, model: NaiveBayes, sentences: int = 2, words: int = 12) -> DataFrame:
    """Per-post ingest shared by batch and stream: clean text, first link,
    summary and headline of the whole text (M2, M3), class (M1), without
    non-news (F3), with slot columns. Cleaned texts have several readers, so
    they are written once."""
    a = checkpoint(m.select(*POST, "date", first_link("message").alias("first_link"), clean_text("message").alias("raw_news")), "cleaned")
    a = a.where(F.length("raw_news") > 0).withColumn("doc_id", F.concat_ws("/", *POST))
    texts = a.select("doc_id", F.col("raw_news").alias("text"))
    short = summaries(texts, sentences, words).select(
        "doc_id", F.col("summary").alias("short_news"), F.col("headline").alias("title"))
    kept = drop_not_news(score_nb(texts, model))
    a = a.join(kept, "doc_id").join(short, "doc_id", "left").drop("doc_id")
    return with_slot(a.withColumns({c: F.coalesce(c, F.lit("")) for c in ("short_news", "title")}))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started here keep their state on disk; the session's own
    setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _run(query_builder):
    q = query_builder.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:  # pragma: no cover - surfaced to caller
        raise RuntimeError(str(q.exception()))
    return q


def run_id(spark: SparkSession, ckpt: str) -> str:
    """The query's id, which its checkpoint keeps over restarts."""
    return json.loads(spark.read.text(f"{ckpt}/metadata").first()[0])["id"]


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def stored_elsewhere(spark: SparkSession, table: str, own: str) -> DataFrame | None:
    """Keys that other runs than ``own`` have stored; none in normal operation,
    where one checkpoint serves all runs."""
    others = [f for f in _folders(spark, table) if not f.endswith(f"run_id={own}")]
    return spark.read.schema("agency string, index long").parquet(*others) if others else None


def _new_only(spark: SparkSession, batch: DataFrame, table: str, ckpt: str) -> tuple[DataFrame, str]:
    own = run_id(spark, ckpt)
    others = stored_elsewhere(spark, table, own)
    return (batch if others is None else batch.join(others, POST, "left_anti")), own


def run_ingest(spark: SparkSession, landing: str, table: str, ckpt: str, model: NaiveBayes, registry: DataFrame,
               high_water: DataFrame | None = None, max_files: int | None = None, observed=None):
    """One collection run: files landed since the last one -> articles
    table (a folder per run and batch, partitioned by ``digest_date``). Posts that came
    before are left out; of rows with one key in a batch one stays.
    ``observed`` adds metrics to the stream (``observe_sources``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # written first: the state is advanced once for each batch, however often the rows are used
        batch, own = _new_only(spark, checkpoint(batch, "posts"), table, ckpt)
        rows = to_articles(batch, model)
        rows.write.mode("overwrite").partitionBy("digest_date").parquet(f"{table}/run_id={own}/batch_id={batch_id}")

    stream = new_posts(message_stream(spark, landing, max_files).dropDuplicates(POST), registry, high_water)
    with rocksdb_state(spark):
        return _run((observed(stream) if observed else stream).writeStream
                    .foreachBatch(write).option("checkpointLocation", ckpt))


def stream_ingest(spark: SparkSession, pages: DataFrame, model: NaiveBayes, registry: DataFrame,
                  max_files: int | None = None) -> DataFrame:
    """Land ``pages``, ingest them, return the table."""
    landing = land(pages, shared_path(spark, "landing"))
    table = shared_path(spark, "news")
    run_ingest(spark, landing, table, shared_path(spark, "ckpt-ingest"), model, registry, max_files=max_files)
    return spark.read.parquet(table)


def observe_sources(stream: DataFrame, registry: DataFrame, group: int = 100) -> tuple[DataFrame, dict[str, tuple[str, int]]]:
    """``stream`` with live counts and times of every active source, and
    where each source's figures are: (name of the observation, place in it).
    Sources go ``group`` to an observation; the registry is a dimension of
    some forty rows."""
    names = [r["agency"] for r in registry.where("is_active").select("agency").distinct().orderBy("agency").collect()]
    places = {}
    for i in range(0, len(names), group):
        name, metrics = f"sources_{i // group}", []
        for k, agency in enumerate(names[i:i + group]):
            mine = F.col("agency") == agency
            metrics += [F.count(F.when(mine, 1)).alias(f"n{k}"), F.min(F.when(mine, F.col("date").cast("string"))).alias(f"first{k}"),
                        F.max(F.when(mine, F.col("date").cast("string"))).alias(f"last{k}")]
            places[agency] = (name, k)
        stream = stream.observe(name, *metrics)
    return stream, places


def live_metrics(progress: list, places: dict[str, tuple[str, int]]) -> list[tuple]:
    """(agency, n_articles, first_date, last_date) over the progress reports of a
    run, for sources with posts."""
    out = {}
    for report in progress:
        seen = report.get("observedMetrics") or {}
        for agency, (name, k) in places.items():
            row = seen.get(name)
            if row is None or not row[f"n{k}"]:
                continue
            n, first, last = out.get(agency, (0, None, None))
            out[agency] = (n + row[f"n{k}"], min(first or row[f"first{k}"], row[f"first{k}"]),
                           max(last or row[f"last{k}"], row[f"last{k}"]))
    return [(agency, *figures) for agency, figures in sorted(out.items())]


def stream_metrics(spark: SparkSession, pages: DataFrame, model: NaiveBayes, registry: DataFrame,
                   high_water: DataFrame | None = None, max_files: int | None = None) -> DataFrame:
    """The live figures of an ingest run, gathered by a listener while it runs."""
    from pyspark.sql.streaming import StreamingQueryListener

    reports: list = []

    class Live(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            reports.append(json.loads(event.progress.json))

        def onQueryTerminated(self, event) -> None:
            pass

    landing, table = land(pages, shared_path(spark, "landing")), shared_path(spark, "news")
    places: dict = {}

    def observed(stream: DataFrame) -> DataFrame:
        stream, found = observe_sources(stream, registry)
        places.update(found)
        return stream

    listener = Live()
    spark.streams.addListener(listener)
    try:
        q = run_ingest(spark, landing, table, shared_path(spark, "ckpt-metrics"), model, registry, high_water, max_files,
                       observed)
        last = [json.loads(p.json) for p in q.recentProgress]
    finally:
        spark.streams.removeListener(listener)
    # the listener is told a little later than the query ends: what it missed is in the query's own reports
    known = {r["batchId"]: r for r in [*reports, *last] if r["id"] == str(q.id)}
    return spark.createDataFrame(live_metrics(list(known.values()), places),
                                 "agency string, n_articles long, first_date string, last_date string")


def run_dedup(spark: SparkSession, landing: str, table: str, ckpt: str, max_files: int | None = None) -> None:
    """T5: one run: posts landed since the last one whose (agency, index) never
    came before, by the keyed state alone. Not the event time decides: an old
    post that was never seen is new."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows, own = _new_only(spark, batch, table, ckpt)
        rows.select(*POST, "date").write.mode("overwrite").parquet(f"{table}/run_id={own}/batch_id={batch_id}")

    with rocksdb_state(spark):
        _run(message_stream(spark, landing, max_files).dropDuplicates(POST).writeStream.foreachBatch(write)
             .option("checkpointLocation", ckpt))


def stream_dedup(spark: SparkSession, waves: list[DataFrame]) -> DataFrame:
    """Land waves of pages one after the other, each followed by a run."""
    landing, table, ckpt = (shared_path(spark, n) for n in ("landing", "dedup", "ckpt-dedup"))
    for pages in waves:
        (pages.select("channel", F.from_json("payload", msg.PAYLOAD).alias("p")).select("channel", "p.messages")
         .write.mode("append").partitionBy("channel").json(landing))
        run_dedup(spark, landing, table, ckpt)
    return spark.read.parquet(table)


def stream_high_water(spark: SparkSession, pages: DataFrame, max_files: int | None = None) -> DataFrame:
    """Per-source high water as a streaming aggregation (state is one row
    per source); each micro-batch rewrites the small result table."""
    landing = land(pages, shared_path(spark, "landing"))
    out = shared_path(spark, "high-water")
    ckpt = shared_path(spark, "ckpt-hw")
    agg = (message_stream(spark, landing, max_files).groupBy("agency")
           .agg(F.max_by("index", F.struct("date", "index")).alias("high_water")))

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    _run(agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", ckpt))
    return spark.read.parquet(out)
