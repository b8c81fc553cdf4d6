"""Quality rules: base measures of a text, and the frequency of its lines
across the documents of its host.

Lines are lower-cased (A-Z and all other letters), runs of white space become
one blank, ends are trimmed; lines without a word don't count. For every host
the documents that hold a line are counted, once each. A line is above the
limit if more than ``max(min_docs, min_share * documents of the host)`` hold
it. Such lines are removed; a document is depleted if fewer than
``keep_share`` of its words are left. ``kept`` is false for depleted documents
and for those that fail the base rules.

All of it is DataFrame operations. A document's measures are array expressions
in its row: the text is read once and never shuffled. Lines travel as hashes,
counted in part before the shuffle; frequent lines (few) go to the rows they
are in, so a hot line is split over all tasks.

Nulls: null text has no words, and so fails; a null host is a host of its own.
Repeated rows are documents of their own. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import SPACE_RUN_RE, SPACES, WORD_RE, written

#: A line is above the limit in more documents than both: the floor decides on hosts of up to
#: 1,000 documents, the share beyond.
MIN_DOCS = 5
MIN_SHARE = 0.005
KEEP_SHARE = 0.5
SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE_RUN_RE, " "))


def _rest(array: str) -> str:
    """SQL of an array without its first element."""
    return f"slice({array}, 2, greatest(size({array}) - 1, 0))"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and ``lines``: (hash, words) of each line with a word."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.withColumn("__text", text) \
        .withColumn("__words", F.filter(F.split("__text", SPACE_RUN_RE), lambda w: w != "")) \
        .withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD_RE)))
    step = step.withColumn("__windows", F.expr(
        "zip_with(zip_with(slice(__words, 1, greatest(size(__words) - 2, 0)), "
        "slice(__words, 2, greatest(size(__words) - 2, 0)), (a, b) -> struct(a, b)), "
        "slice(__words, 3, greatest(size(__words) - 2, 0)), (p, c) -> xxhash64(p.a, p.b, c))"))
    # Windows sorted by hash: equal ones are neighbours; the places of those
    # that have an equal neighbour, sorted again, cover the repeated words.
    step = step.withColumn("__sorted", F.expr(
        "if(size(array_distinct(__windows)) < size(__windows), "
        "sort_array(transform(__windows, (h, i) -> struct(h, i))), "
        "cast(array() as array<struct<h:bigint,i:int>>))"))
    step = step.withColumn("__next", F.expr(
        f"zip_with(__sorted, {_rest('__sorted')}, (x, y) -> struct(x.i as i, coalesce(x.h = y.h, false) as e))"))
    step = step.withColumn("__at", F.expr(
        "sort_array(filter(zip_with(__next, concat(array(false), transform(__next, x -> x.e)), "
        "(x, p) -> if(x.e or p, x.i, null)), i -> i is not null))"))
    gone = lambda chars: F.length("__text") - F.length(F.translate("__text", chars, ""))
    return step.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate("__text", SPACES, "")).cast("long"),
        "n_symbols": gone(SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(f"aggregate(zip_with(__at, {_rest('__at')}, (x, y) -> least(3, coalesce(y - x, 3))), "
                                 "0L, (s, x) -> s + x)"),
        "lines": F.transform("__lines", lambda x: F.struct(
            F.xxhash64(normal_line(x)).alias("hash"),
            F.size(F.filter(F.split(x, SPACE_RUN_RE), lambda w: w != "")).alias("words"))),
    }).drop("__text", "__words", "__lines", "__windows", "__sorted", "__next", "__at")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """host, hash, n_docs of the lines above the limit, from (host, lines)."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    counts = lines.groupBy("host", "hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    h = hosts.select(F.col("host").alias("of"), "docs")
    return counts.join(broadcast_if_small(h), F.col("host").eqNullSafe(F.col("of"))) \
        .where(F.col("n_docs") > F.col("docs") * min_share).select("host", "hash", "n_docs")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, keep_share: float = KEEP_SHARE,
          with_text: bool = False, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source") -> DataFrame:
    """Every row's doc_id, measures, base_failed, removed_words, kept, and with
    ``with_text`` its text without the frequent lines."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                         F.col(text_col).cast("string").alias("text"))
    rows = measured(picked, "text").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows if with_text else rows.drop("text"), "measured")
    hot = written(frequent_lines(rows, min_docs, min_share), "frequent", "snappy")
    each = rows.select("row", F.col("host").alias("of"), F.inline("lines")).withColumnRenamed("hash", "own")
    met = each.join(broadcast_if_small(hot), F.col("of").eqNullSafe(F.col("host")) & (F.col("own") == F.col("hash"))) \
        .groupBy("row").agg(F.sum("words").alias("removed"), F.collect_set("hash").alias("gone"))
    out = rows.join(met, "row", "left") \
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long")) \
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)) \
        .withColumn("kept", ~F.col("base_failed")
                    & (F.col("n_words") - F.col("removed_words") >= F.col("n_words") * keep_share))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "removed_words"]
    if not with_text:
        return out.select(*names)
    rest = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"),
                    lambda x: ~F.coalesce(F.array_contains("gone", F.xxhash64(normal_line(x))), F.lit(False)))
    return out.select(*names, F.when(F.col("text").isNotNull(), F.array_join(rest, "\n")).alias("text"))
