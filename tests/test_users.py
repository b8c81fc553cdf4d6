"""Users, settings, digest assembly and drill-down on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from newsweave import fixtures as fx
from newsweave.operators import digest, stories, users
from newsweave.sources import messages as msg

from conftest import rows

T0 = dt.datetime(2024, 1, 1, 8)


def log_df(spark, rows):
    cols = "user_id long, updated_at timestamp_ntz, seq long, is_subscribed boolean, news_amount int, " + \
        ", ".join(f"{c} boolean" for c in fx.CATEGORY_NAMES)
    return spark.createDataFrame(rows, cols)


def flags(*on):
    return tuple(c in on for c in fx.CATEGORY_NAMES)


def test_latest_settings_ties_and_order(spark):
    log = log_df(spark, [
        (1, T0, 1, True, 3, *flags("click")),
        (1, T0, 2, False, 4, *flags("view")),            # same time, later seq wins
        (2, T0 + dt.timedelta(days=1), 3, True, 2, *flags("error", "view")),
        (2, T0, 9, True, 5, *flags("click")),
    ])
    got = {r["user_id"]: (r["seq"], r["is_subscribed"]) for r in users.latest_settings(log).collect()}
    assert got == {1: (2, False), 2: (3, True)}
    subs = [r["user_id"] for r in users.subscribed_users(log).collect()]
    assert subs == [2]


def test_subscribe_actions_three_way(spark):
    log = log_df(spark, [(1, T0, 1, True, 3, *flags("click")), (2, T0, 2, False, 3, *flags("click"))])
    cmds = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "request_id long, user_id long")
    got = {r["user_id"]: r["action"] for r in users.subscribe_actions(cmds, log).collect()}
    assert got == {1: "none", 2: "resubscribe", 3: "insert"}


def test_settings_or_default(spark):
    log = log_df(spark, [(1, T0, 1, False, 5, *flags("view")), (2, T0, 2, True, 2, *flags("error"))])
    reg = spark.createDataFrame([(1,)], "user_id long")           # 2 has settings but is not registered
    people = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    got = {r["user_id"]: (r["source"], r["news_amount"], r["categories"])
           for r in users.settings_or_default(people, reg, log, fx.default_settings(spark)).collect()}
    assert got[1] == ("own", 5, ["view"])
    assert got[2] == ("default", 3, ["click", "purchase", "signup", "view"])
    assert got[3] == got[2]


def test_settings_apply_unknown_letter_and_case(spark):
    log = log_df(spark, [(1, T0, 1, True, 3, *flags("click")), (2, T0, 2, False, 3, *flags("click"))])
    req = spark.createDataFrame([
        (100, 1, T0, "Vs 4"),     # views + signups, 4 each
        (101, 1, T0, "xq 2"),     # unknown letters -> invalid
        (102, 2, T0, "cv 1"),     # not subscribed -> ignored
        (103, 1, T0, "cc 2"),     # repeated letter
    ], "request_id long, user_id long, sent_at timestamp_ntz, text string")
    got = {r["request_id"]: r for r in users.settings_apply(req, log, fx.categories(spark)).collect()}
    assert set(got) == {100, 103}
    assert got[100]["view"] and got[100]["signup"] and not got[100]["click"] and got[100]["news_amount"] == 4
    assert got[103]["click"] and not got[103]["view"]


def test_asof_digest_latest_before(spark):
    reqs = spark.createDataFrame([(1, 7, T0), (2, 7, T0 + dt.timedelta(hours=30)), (3, 8, T0)],
                                 "request_id long, user_id long, sent_at timestamp_ntz")
    digs = spark.createDataFrame([
        (7, T0 - dt.timedelta(hours=2), dt.date(2024, 1, 1), 2),
        (7, T0 - dt.timedelta(minutes=5), dt.date(2024, 1, 1), 3),
        (7, T0 + dt.timedelta(hours=1), dt.date(2024, 1, 1), 4),
    ], "user_id long, sent_at timestamp_ntz, digest_date date, part int")
    got = {r["request_id"]: (r["digest_date"], r["part"]) for r in users.asof_digest(reqs, digs).collect()}
    assert got == {1: (dt.date(2024, 1, 1), 3), 2: (dt.date(2024, 1, 1), 4), 3: (None, None)}


def test_digest_lines_ranks_and_numbers(spark):
    st = spark.createDataFrame([
        ("2024-01-01", 1, 1, 5, "click", "Big click story"),
        ("2024-01-01", 1, 2, 3, "view", "View story"),
        ("2024-01-01", 1, 3, 2, "click", "Small click story"),
        ("2024-01-01", 1, 4, 1, "view", "Tiny view story"),
    ], "digest_date string, part int, label long, size long, category string, title string")
    settings = spark.createDataFrame([(1, 1, ["click", "view"]), (2, 2, ["view"])],
                                     "user_id long, news_amount int, categories array<string>")
    got = sorted((r["user_id"], r["category_no"], r["rank"], r["label"])
                 for r in digest.digest_lines(st, settings).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 1, 2), (2, 1, 2, 4)]
    people = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "user_id long, first_name string")
    texts = {r["user_id"]: r["text"] for r in
             digest.digest_text(st, settings, people, fx.categories(spark)).collect()}
    assert texts[2] == ("Bob, hello!\n\nYour morning digest for\n01 January 2024:\n"
                        "\nV 1. Views:\n2. View story\n4. Tiny view story\n")


def test_cluster_min_and_links(spark):
    arts = spark.createDataFrame([
        ("2024-01-01", 1, 1, 2, 10, "b", dt.datetime(2024, 1, 1, 1), "view", "T2", "S2", None),
        ("2024-01-01", 1, 1, 2, 11, "a", dt.datetime(2024, 1, 1, 2), "click", "T1", "S9", "https://x.org"),
    ], "digest_date string, part int, label long, size long, index long, agency string, date timestamp_ntz, "
       "category string, title string, short_news string, first_link string")
    m = stories.cluster_min(arts).first()
    assert (m["agency"], m["category"], m["title"], m["short_news"]) == ("a", "click", "T1", "S2")
    links = sorted(r["link"] for r in stories.cluster_links(arts).collect())
    assert links == ["https://t.me/a/11", "https://t.me/b/10", "https://x.org"]


def test_incremental_high_water_and_new_source(spark):
    stored = spark.createDataFrame([("a", 5, T0), ("a", 3, T0 + dt.timedelta(hours=1))],
                                   "agency string, index long, date timestamp_ntz")
    incoming = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("a", 6, ""), ("b", 1, "z")],
                                     "agency string, index long, message string")
    hw = {r["agency"]: r["high_water"] for r in msg.high_water(stored).collect()}
    assert hw == {"a": 3}                       # newest date, not largest id
    got = sorted((r["agency"], r["index"]) for r in msg.incremental(incoming, stored).collect())
    assert got == [("a", 4), ("b", 1)]          # empty body dropped; unseen source starts at 0


def test_user_events_follow_the_state(spark):
    log = log_df(spark, [(1, T0, 1, True, 2, *flags("view")), (2, T0, 2, False, 4, *flags("click"))])
    day = lambda n: T0 + dt.timedelta(days=n)
    commands = spark.createDataFrame([
        (10, 1, day(1), "subscribe"), (11, 1, day(2), "unsubscribe"), (12, 1, day(3), "unsubscribe"),
        (13, 1, day(4), "subscribe"), (20, 2, day(1), "subscribe"), (30, 3, day(1), "unsubscribe"),
        (31, 3, day(2), "subscribe"), (32, 3, day(3), "subscribe"), (33, 3, day(4), "unsubscribe")],
        "request_id long, user_id long, sent_at timestamp_ntz, command string")
    got = {r["seq"]: (r["action"], r["is_subscribed"], r["news_amount"]) for r in
           users.user_events(commands, log, fx.default_settings(spark)).collect()}
    n = fx.DEFAULT_NEWS_AMOUNT
    assert got == {11: ("unsubscribe", False, 2), 13: ("resubscribe", True, 2), 20: ("resubscribe", True, 4),
                   31: ("insert", True, n), 33: ("unsubscribe", False, n)}


def test_day_digest_serves_whole_days(spark):
    st = spark.createDataFrame([
        ("2024-01-01", 0, 1, 5, "click", "Day click"), ("2024-01-01", 0, 2, 3, "click", "Second click"),
        ("2024-01-01", 2, 1, 9, "click", "Slot click"), ("2024-01-02", 0, 1, 5, "view", "Other day")],
        "digest_date string, part int, label long, size long, category string, title string")
    st = st.withColumn("digest_date", F.to_date("digest_date"))
    settings = spark.createDataFrame([(1, 1, ["click"]), (2, 2, ["view", "click"])],
                                     "user_id long, news_amount int, categories array<string>")
    req = spark.createDataFrame([(7, 1, "2024-01-01"), (8, 2, "2024-01-01"), (9, 2, "2024-01-05")],
                                "request_id long, user_id long, digest_date string") \
        .withColumn("digest_date", F.to_date("digest_date"))
    lines = digest.day_digest(req, settings, st)
    assert sorted((r["request_id"], r["category_no"], r["rank"], r["title"]) for r in lines.collect()) == \
        [(7, 1, 1, "Day click"), (8, 2, 1, "Day click"), (8, 2, 2, "Second click")]
    people = spark.createDataFrame([(1, "Ann")], "user_id long, first_name string")
    texts = {r["request_id"]: r["text"] for r in digest.day_digest_text(lines, people, fx.categories(spark)).collect()}
    assert texts[7].startswith("Ann, hello!\n\nYour digest for\n01 January 2024:\n\nC 1. Clicks:\n1. Day click\n")
    assert texts[8].startswith("Reader, hello!") and texts[8].count("\n") == texts[7].count("\n") + 1


def _stories_and_settings(spark):
    st = spark.createDataFrame([("2024-01-0%d" % (1 + i % 3), 1 + i % 2, i + 1, 9 - i % 9, "view" if i % 4 else "click", f"t{i}") for i in range(24)],
                               "digest_date string, part int, label long, size long, category string, title string") \
        .withColumn("digest_date", F.to_date("digest_date"))
    settings = spark.createDataFrame([(u, 1 + u % 3, ["view", "click"] if u % 2 else ["click"]) for u in range(60)],
                                     "user_id long, news_amount int, categories array<string>")
    return st, settings


def test_digest_lines_deal_few_bytes_of_settings_over_many_tasks(spark, monkeypatch):
    st, settings = _stories_and_settings(spark)
    settings = settings.coalesce(1)
    whole = rows(digest.digest_lines(st, settings))
    monkeypatch.setattr(digest, "TASK_LINES", 100)
    dealt = digest.digest_lines(st, settings)
    assert dealt.rdd.getNumPartitions() > 5 and rows(dealt) == whole


def test_equal_settings_share_one_text(spark):
    """The texts are those of the lines, and no user's text is put together by
    a group of its own."""
    st, settings = _stories_and_settings(spark)
    people = spark.createDataFrame([(u, f"n{u}") for u in range(50)], "user_id long, first_name string")
    texts = digest.digest_text(st, settings, people, fx.categories(spark))
    assert "collect_list" not in texts._jdf.queryExecution().executedPlan().toString()
    want = {}
    for u, day, part, no, c, rank, label, title in rows(digest.digest_lines(st, settings)):
        want.setdefault((u, day, part), {}).setdefault(no, []).append((rank, f"{label}. {title}\n"))
    got = {(r["user_id"], r["digest_date"], r["part"]): r["text"] for r in texts.collect()}
    assert got.keys() == want.keys() and len(got) == texts.count()
    for (u, day, part), nos in want.items():
        name = f"n{u}" if u < 50 else "Reader"
        assert got[u, day, part].startswith(f"{name}, hello!\n")
        pieces = ["".join(line for _, line in sorted(nos[no])) for no in sorted(nos)]
        at = [got[u, day, part].index(p) for p in pieces]
        assert at == sorted(at) and got[u, day, part].count("\n") == 4 + sum(2 + p.count("\n") for p in pieces)


def test_asof_digest_reads_the_log_once(spark, monkeypatch):
    """The log of digests is reduced to the users who asked, once, and written."""
    names, cut = [], users.checkpoint
    monkeypatch.setattr(users, "checkpoint", lambda df, name: (names.append((name, df.count())), cut(df, name))[1])
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))"
    reqs = spark.range(20).selectExpr("id as request_id", "id % 2 as user_id", f"{at} as sent_at")
    digs = spark.range(100).selectExpr("id % 10 as user_id", f"{at} as sent_at", "date'2024-01-01' as digest_date", "1 as part")
    got = users.asof_digest(reqs, digs)
    assert got.count() == 20 and names == [("asof-requests", 20), ("asof-users", 2), ("asof-digests", 20)]
    assert "range" not in got._jdf.queryExecution().executedPlan().toString().lower()
