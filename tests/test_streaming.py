"""Batch = stream: the availableNow ingest over landed payload files gives the
same rows as the batch transform of the same files."""

from pyspark.sql import functions as F

from newsweave import fixtures as fx
from newsweave.plans import queries as Q
from newsweave.session import shared_path
from newsweave.sources import messages as msg
from newsweave.streaming import ingest, slots

from conftest import SF_SMALL


def test_stream_ingest_equals_batch(spark):
    pages, registry, model = fx.message_pages(spark, SF_SMALL), fx.agencies(spark, SF_SMALL), Q._model(spark, SF_SMALL)
    streamed = ingest.stream_ingest(spark, pages, model, registry, max_files=7)
    path = msg.land_payloads(pages, shared_path(spark, "landing-batch"))
    batch = ingest.to_articles(msg.active_sources(msg.read_messages(spark, path), registry), model)
    cols = ["agency", "index", "date", "title", "short_news", "digest_date", "part", "first_link", "category"]
    a = sorted((tuple(r) for r in streamed.select(*cols).collect()), key=repr)
    b = sorted((tuple(r) for r in batch.select(*cols).collect()), key=repr)
    assert a == b and len(a) > 0


def test_stream_rerun_processes_only_new_files(spark):
    """A second availableNow run over the same checkpoint adds nothing."""
    pages, registry, model = fx.message_pages(spark, SF_SMALL), fx.agencies(spark, SF_SMALL), Q._model(spark, SF_SMALL)
    landing = ingest.land(pages, shared_path(spark, "landing-rerun"))
    table, ckpt = shared_path(spark, "news-rerun"), shared_path(spark, "ckpt-rerun")

    def run():
        ingest.run_ingest(spark, landing, table, ckpt, model, registry)
        return spark.read.parquet(table).count()

    first = run()
    assert run() == first > 0


def posts(spark, ids, agency="src0"):
    day = 1705000000
    return spark.createDataFrame(
        [(agency, "p", f'{{"messages":[{{"id":{i},"date":{day + i * 86400},"message":"m{i}"}}]}}') for i in ids],
        "channel string, page string, payload string")


def test_old_unseen_posts_survive_and_repeated_ones_do_not(spark):
    waves = [posts(spark, [20, 21, 21]), posts(spark, [20, 22]), posts(spark, [2, 3, 20, 22]).unionByName(
        posts(spark, [20], "src1"))]
    out = ingest.stream_dedup(spark, waves)
    assert sorted((r["agency"], r["index"]) for r in out.collect()) == \
        [("src0", i) for i in (2, 3, 20, 21, 22)] + [("src1", 20)]


def test_a_retried_batch_adds_nothing(spark):
    """The last batch again, as after a failure before its commit."""
    landing, table, ckpt = (shared_path(spark, n) for n in ("landing", "retry", "ckpt"))
    for ids in ([1, 2], [2, 3]):
        (posts(spark, ids).select("channel", F.from_json("payload", msg.PAYLOAD).alias("p")).select("channel", "p.messages")
         .write.mode("append").partitionBy("channel").json(landing))
        ingest.run_dedup(spark, landing, table, ckpt)
    spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/1").getFileSystem(spark._jsc.hadoopConfiguration()) \
        .delete(spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/1"), False)
    ingest.run_dedup(spark, landing, table, ckpt)
    assert sorted(r["index"] for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def land(spark, path, *ids):
    (posts(spark, ids).select("channel", F.from_json("payload", msg.PAYLOAD).alias("p")).select("channel", "p.messages")
     .write.mode("append").partitionBy("channel").json(path))


def indexes(spark, table):
    return sorted(r["index"] for r in spark.read.parquet(table).collect())


def test_a_new_checkpoint_loses_and_repeats_nothing(spark):
    """Stored rows stay, seen posts stay out, unseen old ones come in; also
    when the new checkpoint goes on over several batches."""
    landing, table = shared_path(spark, "landing"), shared_path(spark, "fresh")
    land(spark, landing, 5, 6)
    ingest.run_dedup(spark, landing, table, shared_path(spark, "ckpt-one"))
    land(spark, landing, 1, 6, 7)
    second = shared_path(spark, "ckpt-two")
    ingest.run_dedup(spark, landing, table, second, max_files=1)
    assert indexes(spark, table) == [1, 5, 6, 7]
    land(spark, landing, 2, 5, 7, 8)
    ingest.run_dedup(spark, landing, table, second)
    assert indexes(spark, table) == [1, 2, 5, 6, 7, 8]


def test_ingest_with_a_new_checkpoint_and_a_retry(spark):
    pages, registry, model = fx.message_pages(spark, SF_SMALL), fx.agencies(spark, SF_SMALL), Q._model(spark, SF_SMALL)
    landing = ingest.land(pages, shared_path(spark, "landing"))
    table, ckpt = shared_path(spark, "news"), shared_path(spark, "ckpt")
    key = lambda: sorted((r["agency"], r["index"]) for r in spark.read.parquet(table).collect())
    ingest.run_ingest(spark, landing, table, ckpt, model, registry)
    first = key()
    fs = spark._jvm.org.apache.hadoop.fs.Path(ckpt).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/0"), False)
    ingest.run_ingest(spark, landing, table, ckpt, model, registry)
    assert key() == first and len(set(first)) == len(first) > 0
    ingest.run_ingest(spark, landing, table, shared_path(spark, "ckpt-new"), model, registry)
    assert key() == first


def test_dedup_reads_only_what_landed(spark):
    """The keyed state decides: the rows of a batch are those of its files, and
    no stored table is read while one checkpoint serves."""
    landing, table, ckpt = (shared_path(spark, n) for n in ("landing", "state", "ckpt"))
    read = []
    for wave in ([1, 2, 3], [3, 4], [4, 5, 6, 7]):
        land(spark, landing, *wave)
        q = ingest.message_stream(spark, landing).dropDuplicates(ingest.POST)
        with ingest.rocksdb_state(spark):
            done = ingest._run(q.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{table}/batch_id={i}"))
                               .option("checkpointLocation", ckpt))
        read.append(sum(p.numInputRows for p in done.recentProgress))
        assert ingest.stored_elsewhere(spark, shared_path(spark, "none"), "x") is None
    assert indexes(spark, table) == [1, 2, 3, 4, 5, 6, 7] and read == [3, 2, 4]  # a line of JSON for each


def test_bad_records_are_kept(spark):
    path = shared_path(spark, "bad")
    lines = ['{"messages": [{"id": 1, "date": 5, "message": "ok"}]}', '{"messages": [{"id": 2, "da', "", "no json", '{"page": 3}',
             '{"messages": null}', '{"messages": []}', "[1, 2]"]
    msg.land_raw(spark.createDataFrame([("c", x) for x in lines], "channel string, payload string"), path)
    bad = msg.bad_records(spark, path).collect()
    assert sorted((r["reason"], r["record"]) for r in bad if r["record"] != "[1, 2]") == [
        ("no messages", '{"messages": null}'), ("no messages", '{"page": 3}'), ("unparsable", "no json"),
        ("unparsable", '{"messages": [{"id": 2, "da')]
    assert all(r["channel"] == "c" and path.split("/")[-1] in r["file"] for r in bad)
    assert [r["message"] for r in msg.read_messages(spark, path).collect()] == ["ok"]


def test_a_batch_written_again_replaces_itself(spark):
    from newsweave.sources import sinks
    path = shared_path(spark, "articles")
    a = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "index long, digest_date string")
    for batch, rows in (("one", a), ("two", a.selectExpr("index + 2 as index", "digest_date")), ("one", a)):
        sinks.append_articles(rows, path, batch)
    assert indexes(spark, path) == [1, 2, 3, 4]


def test_delivery_is_once_for_each_user_and_slot(spark):
    from newsweave.sources import sinks
    log = shared_path(spark, "sent")
    t = spark.createDataFrame([(1, "2024-01-01", 2, "a"), (2, "2024-01-01", 2, "b"), (1, "2024-01-01", 3, "c")],
                              "user_id long, digest_date string, part int, text string")
    at = F.lit("2024-01-01 13:00:00")
    sinks.deliver(spark, t.where("user_id = 1 and part = 2"), log, at, exists=False)
    for rows in (t, t.where("part = 2"), t):
        sinks.deliver(spark, rows, log, F.lit("2024-01-02 00:00:00"))
    got = sorted((r["user_id"], r["part"], r["text"], str(r["sent_at"])[:10]) for r in sinks.read_deliveries(spark, log).collect())
    assert got == [(1, 2, "a", "2024-01-01"), (1, 3, "c", "2024-01-02"), (2, 2, "b", "2024-01-02")]


def test_delivery_again_reads_no_texts(spark):
    """Who is due is found by keys, so a text without a user is sent once too."""
    from newsweave.sources import sinks
    log = shared_path(spark, "sent")
    t = spark.createDataFrame([(None, "2024-01-01", 2, "a"), (2, "2024-01-01", 2, "b")],
                              "user_id long, digest_date string, part int, text string")
    at = F.lit("2024-01-01 13:00:00")
    sinks.deliver(spark, t, log, at, exists=False)
    unread = t.withColumn("text", F.raise_error(F.lit("text read")).cast("string"))
    sinks.deliver(spark, unread, log, at)
    assert sorted(r["text"] for r in sinks.read_deliveries(spark, log).collect()) == ["a", "b"]


def test_slots_close_once_and_the_state_stays_small(spark):
    """Events of many days in files of one day each: every slot is handed on
    once, and the state holds the open hours alone."""
    from newsweave.functions.time import digest_date, slot_part
    ev = spark.range(20 * 24 * 4).selectExpr("timestamp_ntz'2024-03-01 00:00:00' + make_interval(0,0,0,0,0,15*cast(id as int)) as ts",
                                             "id div 96 as day")
    folder, out, ckpt = (shared_path(spark, n) for n in ("events", "closed", "ckpt-closed"))
    for day in range(20):
        ev.where(f"day = {day}").drop("day").coalesce(1).write.mode("append").parquet(folder)
        slots.run_slot_close(spark, spark.readStream.schema("ts timestamp_ntz").parquet(folder), out, ckpt)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/slots").select("digest_date", "part", "n_events").collect())
    want = {(r[0], r[1]): r[2] for r in ev.groupBy(digest_date("ts"), slot_part("ts")).count().collect()}
    assert len(got) == len(set(g[:2] for g in got)) and all(want[g[:2]] == g[2] for g in got)
    assert len(want) - len(got) <= 2  # the last slots are still open
    assert spark.read.parquet(f"{out}/open").where("batch_id = 39").count() <= 10


def test_late_arrivals_beyond_the_watermark_are_counted(spark):
    from newsweave.streaming import late
    rows = [("2024-01-01 10:00:00", "2024-01-01 10:00:00"), ("2024-01-01 20:00:00", "2024-01-01 20:10:00"),
            ("2024-01-01 10:30:00", "2024-01-01 21:00:00"), ("2024-01-01 19:50:00", "2024-01-01 21:10:00"),
            ("2024-01-01 23:50:00", "2024-01-01 23:55:00"), ("2023-12-20 10:00:00", "2024-01-02 00:10:00")]
    df = [spark.createDataFrame([r], "a string, b string").selectExpr("cast(a as timestamp_ntz) ts", "cast(b as timestamp_ntz) arrival_ts")
          for r in rows]
    got = {(str(r[0]), r[1]): (r[2], r[3]) for r in late.stream_late_counts(spark, df, "2 hours").collect()}
    assert got == {("2024-01-01", 2): (2, 1), ("2024-01-01", 4): (2, 0), ("2024-01-02", 1): (1, 0), ("2023-12-20", 2): (1, 1)}


def test_live_metrics_equal_the_batch_metrics(spark):
    from newsweave.sources import sinks
    pages, registry, model = fx.message_pages(spark, SF_SMALL), fx.agencies(spark, SF_SMALL), Q._model(spark, SF_SMALL)
    live = ingest.stream_metrics(spark, pages, model, registry, max_files=3)
    path = msg.land_payloads(pages, shared_path(spark, "landing"))
    batch = sinks.ingest_metrics(msg.active_sources(msg.read_messages(spark, path), registry))
    want = sorted((r[0], r[1], str(r[2]), str(r[3])) for r in batch.collect())
    assert sorted(tuple(r) for r in live.collect()) == want and len(want) > 3


def test_observations_do_not_keep_a_model_from_training(spark):
    """A session that has used observations trains an MLlib model all the same."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Observation
    seen = Observation("train")
    rows = spark.range(40).selectExpr("cast(id as double) x", "cast(id > 20 as double) label")
    assert rows.observe(seen, F.count("*").alias("n")).count() == 40 and seen.get["n"] == 40
    model = LogisticRegression(maxIter=5).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    assert model.numClasses == 2


def test_hourly_rollup_equals_batch_slots(spark):
    from newsweave.functions.time import digest_date, slot_part
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    got = {(r[0], r[1]): r[2] for r in slots.stream_slot_counts(spark, SF_SMALL, ev.schema).collect()}
    want = {(r[0], r[1]): r[2] for r in ev.groupBy(digest_date("ts"), slot_part("ts")).count().collect()}
    assert got == want


def test_late_rows_flag(spark):
    a = fx.arrivals(spark, SF_SMALL)
    late = slots.late_rows(a).agg(F.sum("n_late")).first()[0]
    assert late == a.where("is_late").count()


def test_landed_files_follow_the_size(spark, tmp_path):
    """Pages that many tasks made land in few files, and no page is lost."""
    from newsweave.sources import messages as msg
    pages = spark.range(0, 400, 1, 16).selectExpr("if(id % 4 = 0, 'b', 'a') channel", "id page",
                                                  "concat('{\"messages\": [{\"id\": ', id, ', \"date\": 1, \"message\": \"m', id, '\"}]}') payload")
    for size, least, most in ((1 << 20, 2, 2), (4000, 2, 16)):
        path = msg.land_payloads(pages, str(tmp_path / str(size)), size)
        files = list((tmp_path / str(size)).glob("channel=*/*.json"))
        assert least <= len(files) <= most
        got = msg.read_messages(spark, path)
        assert got.select("index").distinct().count() == got.count() == 400


def test_cleaned_texts_are_written_once(spark):
    from newsweave.operators.classify import NaiveBayes
    from newsweave.streaming.ingest import to_articles
    m = spark.createDataFrame([("a", 1, "<b>one word</b>")], "agency string, index long, message string").withColumn(
        "date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    model = NaiveBayes(spark.createDataFrame([("one", 0.0)], "word string, news double"), {"news": 0.0})
    p = to_articles(m, model)
    assert "<[^>]*>" not in p._jdf.queryExecution().optimizedPlan().toString()
    assert [r["short_news"] for r in p.collect()] == ["one word"]


def test_delivered_slots_are_done_without_comparing_users(spark, monkeypatch):
    """A second delivery looks at single users only in slots that differ."""
    from newsweave.sources import sinks
    log, names, cut = shared_path(spark, "sent"), [], sinks.checkpoint
    monkeypatch.setattr(sinks, "checkpoint", lambda df, name: (names.append((name, df.count())), cut(df, name))[1])
    t = spark.range(300).selectExpr("id as user_id", "date'2024-01-01' + cast(id % 3 as int) as digest_date", "cast(id % 2 as int) as part",
                                    "concat('t', id) as text")
    at = F.lit("2024-01-09 13:00:00")
    sinks.deliver(spark, t, log, at, exists=False)
    sinks.deliver(spark, t, log, at)
    assert names == [("due-slots", 6), ("open-slots", 0)]
    names.clear()
    more = t.unionByName(t.where("user_id in (6, 7)").withColumn("user_id", F.col("user_id") + 1000))
    sinks.deliver(spark, more, log, at, keys=more.drop("text"))
    assert names[1:] == [("open-slots", 2), ("due", 102), ("undelivered", 2)]
    back = sinks.read_deliveries(spark, log)
    assert back.count() == back.select("user_id", "digest_date", "part").distinct().count() == 302


def test_the_log_of_digests_is_written_without_sorting_texts(spark):
    """Groups of readers are put in the order of the slots before they are
    taken apart, and the writer adds no sort."""
    from newsweave.operators import digest
    from newsweave.plans import pipeline as pl
    from newsweave.sources import sinks
    args = pl.story_table(spark, SF_SMALL), pl.subscriber_settings(spark, SF_SMALL), fx.users(spark, SF_SMALL), fx.categories(spark)
    texts, keys = digest.digest_parts(*args, pl.slot_views(spark, SF_SMALL))
    p = texts._jdf.queryExecution().executedPlan().toString()
    assert "readers" in p.split("Sort [")[1].split("\n")[1] or "Generate explode(readers" in p.split("Sort [")[0]
    got = sorted(map(tuple, texts.drop("text").collect()))
    assert got == sorted(map(tuple, keys.collect())) and len(got) == len(set(got)) > 0
    log = shared_path(spark, "sent")
    was = spark.conf.get(sinks.OPEN_FILES)
    sinks.deliver(spark, texts, log, F.lit("2024-01-09 13:00:00"), exists=False)
    assert spark.conf.get(sinks.OPEN_FILES) == was and sinks.read_deliveries(spark, log).count() == len(got)
