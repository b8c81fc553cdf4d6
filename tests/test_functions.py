"""Scalar functions on literal edge rows (FIXTURES.md, "Literal unit rows")."""

import datetime as dt

from pyspark.sql import functions as F

from newsweave.functions import requests as rq
from newsweave.functions import text as tx
from newsweave.functions import time as tm


def one(spark, col, value, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]


def test_first_link_cases(spark):
    cases = {
        "<p>no anchor</p>": None,
        '<a name="x">first</a> <a href="https://b.org">second</a>': None,
        '<a href="tg://resolve?domain=x">chat</a>': None,
        '<div><p><a class="c" href="https://a.org/x?y=1&amp;z=2">t</a></p></div>': "https://a.org/x?y=1&z=2",
        "<A HREF='https://c.org'>up</A>": "https://c.org",
        '<!-- <a href="https://hidden.org"> --><a href="https://shown.org">x</a>': "https://shown.org",
        '<abbr href="https://no.org">x</abbr>': None,
        '<a href="">empty</a>': None,
    }
    for html, want in cases.items():
        assert one(spark, tx.first_link(F.col("s")), html) == want, html


def test_html_to_text_entities_and_nesting(spark):
    assert one(spark, tx.html_to_text(F.col("s")), "<p>a <b>b</b></p><p>c</p>") == "a bc"
    assert one(spark, tx.html_to_text(F.col("s")), "x &amp;lt; y") == "x &lt; y"
    assert one(spark, tx.html_to_text(F.col("s")), "&quot;q&quot; &middot; &copy;") == '"q" · ©'
    assert one(spark, tx.html_to_text(F.col("s")), "<script>var a='<p>';</script>t<style>p{}</style>") == "t"


def test_flatten_and_labels(spark):
    assert one(spark, tx.flatten_space(F.col("s")), "a b\nc") == "a b c"
    for label in tx.BOILERPLATE_LABELS:
        assert one(spark, tx.strip_labels(F.col("s")), "x" + label + "y") == "x\ny"
        # a text that is only a label survives as a newline (not empty)
        assert one(spark, tx.strip_labels(F.col("s")), label) == "\n"
    assert one(spark, tx.clean_text(F.col("s")), "") == ""


def test_clean_word_cases(spark):
    cases = {"--x-": "x", "12": "", "Ёлка": "ёлка", "semi-final": "semi-final", "Hello,": "hello"}
    for w, want in cases.items():
        assert one(spark, tx.clean_word(F.col("s")), w) == want, w


def test_tokenise_unicode_space(spark):
    assert one(spark, tx.tokenise(F.col("s")), "a b  c\td") == ["a", "b", "c", "d"]
    assert one(spark, tx.tokenise(F.col("s")), "") == []


def test_label_suffix_and_capitalise(spark):
    assert one(spark, tx.label_suffix(F.col("s")), "__label__sports") == "sports"
    assert one(spark, tx.label_suffix(F.col("s")), "plain") == "plain"
    assert one(spark, tx.capitalise(F.col("s")), "pOLITICS and more") == "Politics and more"


def test_article_links(spark):
    df = spark.createDataFrame([("https://x.org", "chan", 7), (None, "chan", 8)],
                               "fl string, agency string, idx long")
    got = [r[0] for r in df.select(tx.article_links("fl", "agency", "idx")).collect()]
    assert got == ["https://x.org https://t.me/chan/7", "https://t.me/chan/8"]


def test_slot_edges(spark):
    cases = [
        (dt.datetime(2024, 1, 5, 20, 59, 59), dt.date(2024, 1, 5), 4),
        (dt.datetime(2024, 1, 5, 21, 0, 0), dt.date(2024, 1, 6), 1),
        (dt.datetime(2024, 1, 6, 6, 59, 59, 500000), dt.date(2024, 1, 6), 1),
        (dt.datetime(2024, 1, 6, 7, 0, 0), dt.date(2024, 1, 6), 2),
        (dt.datetime(2024, 1, 31, 22, 0, 0), dt.date(2024, 2, 1), 1),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "ts timestamp_ntz")
    got = df.select(tm.digest_date("ts"), tm.slot_part("ts")).collect()
    assert [(r[0], r[1]) for r in got] == [(c[1], c[2]) for c in cases]


def test_slot_bounds_half_open(spark):
    df = spark.createDataFrame([(p,) for p in range(5)], "p int")
    s, e = tm.slot_bounds(F.lit("2024-01-10"), F.col("p"))
    got = {r[0]: (r[1], r[2]) for r in df.select("p", s, e).collect()}
    assert got[0] == (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11))
    assert got[1] == (dt.datetime(2024, 1, 9, 21), dt.datetime(2024, 1, 10, 7))
    assert got[4] == (dt.datetime(2024, 1, 10, 17), dt.datetime(2024, 1, 10, 21))


def test_parse_date_and_guard(spark):
    assert one(spark, tm.parse_date(F.col("s")), "2022-7-2") == dt.date(2022, 7, 2)
    assert one(spark, tm.parse_date(F.col("s")), "2022-02-30") is None
    assert one(spark, tm.parse_date(F.col("s")), "x2022-01-01") is None
    assert one(spark, tm.date_guard(tm.parse_date(F.col("s")), "2024-01-25"), "2022-06-27") is False
    assert one(spark, tm.date_guard(tm.parse_date(F.col("s")), "2024-01-25"), "2024-01-25") is True


def test_request_kinds(spark):
    cases = {"2024-01-05": "digest", "2024-1-5": "digest", "3 7": "coordinates", "3 x": "invalid",
             "2022-02-30": "invalid", "cs 5": "settings", "Ab 2 more": "settings", "cs": "invalid",
             "?!": "ignored", "": "ignored"}
    for text, want in cases.items():
        assert one(spark, rq.classify_request(F.col("s")), text) == want, text
    df = spark.createDataFrame([("3 7",)], "s string")
    n, lab = rq.parse_coordinates("s")
    assert tuple(df.select(n, lab).first()) == (3, 7)


def test_epoch_and_display(spark):
    assert one(spark, tm.epoch_to_time(F.col("s")), 0, "s long") == dt.datetime(1970, 1, 1)
    assert one(spark, tm.epoch_to_time(F.col("s"), "Europe/Moscow"), 0, "s long") == dt.datetime(1970, 1, 1, 3)
    got = one(spark, tm.display_date(F.col("s")), dt.datetime(2024, 1, 5, 3, 4, 5), "s timestamp_ntz")
    assert got == "05 January 2024 - 03:04:05"
    assert one(spark, tm.part_greeting(F.col("s")), 0, "s int") is None


def test_location_struct(spark):
    df = spark.createDataFrame([("55.75", 37.62)], "lat string, lon double")
    r = df.select(rq.location_struct("lat", "lon").alias("loc")).first()["loc"]
    assert (r["lat"], r["lon"]) == (55.75, 37.62)
