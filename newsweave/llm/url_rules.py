"""URL filter: explicit host and path rules, then association rules mined from
labelled pages.

The url of a page becomes a set of tokens: host labels, the host's endings,
path segments (digits as one mark), and names of query parameters. Tokens that
stand in the same labelled pages are one item: host labels and their endings,
or all steps of a url that is repeated. Spark's FP-growth mines the item sets
of labelled pages, with one more item for bad ones; the rules "items -> bad"
with enough support and confidence stay, less those that hold a shorter rule's
items. An item that is a rule on its own leaves the pages before the sets are
mined, as every longer rule with it would go. A page is blocked if it has, for
each item of a rule, one of its tokens; that is what rules over tokens would
say. Rules and pages meet on single tokens through an inverted index, and a
rule fires when all its items were met.

An explicit rule fits its host and all subdomains if the page's path starts
with the rule's; the longest that fits decides before any mined rule.

All of it is DataFrame operations. A frequent token meets only the rules that
hold it, and urls are matched once each.

What grows fast is the number of item sets: pages that share many items, no two
of which stand in the same pages, still have as many sets as subsets.

Nulls: a null url or one without ``://`` has empty host and path, no tokens,
and is allowed. Labels that are null count as good; pages without label are
not mined. No labelled or no bad page: no mined rules. Repeated pages: each
row is judged, with equal results. Very long urls: tokens beyond 40 of the
same page are as good as any other; none is cut. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"
#: A rule's bad pages: this share of the labelled pages, and this many.
MIN_SUPPORT, MIN_PAGES = 0.002, 3
MIN_CONFIDENCE = 0.6


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, host, path) that fits,
    else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url; empty without host."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("end:"), F.array_join(F.slice(labels, i, n), ".")))
    steps = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(
        F.lit("step:"), F.regexp_replace(F.translate(s, UPPER, LOWER), "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""),
                        lambda s: F.concat(F.lit("name:"), F.substring_index(s, "=", 1)))
    every = F.array_distinct(F.concat(F.transform(labels, lambda s: F.concat(F.lit("label:"), s)), ends, steps, names))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def _items(pairs: DataFrame) -> DataFrame:
    """token, item of (row, token): tokens in the same rows share an item, the
    least of them. A token's rows are known by their number and two sums of
    64-bit hashes."""
    signs = pairs.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"),
                                       F.bit_xor(F.xxhash64("row", F.lit("second"))).alias("y"))
    same = ["n", "x", "y"]
    return signs.join(signs.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         page_id: str = "page_id", label_id: str = "doc_id", min_pages: int = MIN_PAGES) -> DataFrame:
    """rule (an id), tokens (an item's least token each), alternatives (all
    tokens of each item), confidence, support: rules towards bad pages, without
    those that contain a shorter one."""
    spark = pages.sparkSession
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    marks = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("of")) \
        .agg(F.max(bad).alias("bad"))
    known = pages.select(F.col(page_id).alias("page"), tokens_of(F.col("url")).alias("tokens")) \
        .join(marks, F.col("page") == F.col("of")).where(F.size("tokens") > 0).select("tokens", "bad")
    known = written(known.withColumn("row", F.monotonically_increasing_id()), "labelled", "snappy")
    empty = "rule long, tokens array<string>, alternatives array<array<string>>, confidence double, support double"
    if not known.where("bad").take(1):
        return spark.createDataFrame([], empty)
    n = known.count()
    least_pages = max(min_pages, math.ceil(min_support * n))
    pairs = known.select("row", "bad", F.explode("tokens").alias("token"))
    items = written(_items(pairs), "items", "snappy")
    held = written(pairs.join(broadcast_if_small(items), "token").select("row", "bad", "item").distinct(), "page-items", "snappy")
    single = written(held.groupBy("item").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
                     .where(F.col("b") >= least_pages), "item-counts", "snappy")
    alone = (F.col("b") / F.col("n")).alias("confidence")
    kept = [single.select(F.array("item").alias("tokens"), alone, (F.col("b") / n).alias("support"))
            .where(F.col("confidence") >= min_confidence)]
    # what is left: items of enough bad pages that are no rule yet
    rest = held.join(broadcast_if_small(single.where(F.col("b") / F.col("n") < min_confidence).select("item")), "item")
    sets = rest.groupBy("row", "bad").agg(F.collect_set("item").alias("items"))
    sets = written(sets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items"))
                               .alias("items")), "item-sets", "snappy")
    # shares are of the sets that are left; the count is the same
    if m := sets.count():
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least_pages - 0.5) / m), minConfidence=min_confidence).fit(sets)
        rules = model.associationRules.where(F.element_at("consequent", 1) == BAD) \
            .select(F.monotonically_increasing_id().alias("rule"), F.array_sort("antecedent").alias("tokens"), "confidence",
                    (F.col("support") * m / n).alias("support"))
    else:
        rules = spark.createDataFrame([], "rule long, tokens array<string>, confidence double, support double")
    left = written(rules, "rules", "snappy")
    # Shortest first: a longer rule is met by the parts of a kept one, as a page is by a rule.
    while (least := left.agg(F.min(F.size("tokens"))).first()[0]) is not None:
        short = left.where(F.size("tokens") == least)
        kept.append(short.drop("rule"))
        longer = left.where(F.size("tokens") > least)
        index = short.select(F.col("rule").alias("short"), F.explode("tokens").alias("token"))
        holds = longer.select("rule", F.explode("tokens").alias("token")).join(broadcast_if_small(index), "token") \
            .groupBy("rule", "short").agg(F.count("*").alias("met")).where(F.col("met") == least)
        left = written(longer.join(holds.select("rule").distinct(), "rule", "left_anti"), "rules-longer", "snappy")
    found = written(reduce(DataFrame.unionByName, kept).withColumn("rule", F.monotonically_increasing_id()), "rules-short", "snappy")
    tokens = items.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("any"))
    each = found.select("rule", F.explode("tokens").alias("item")).join(tokens, "item") \
        .groupBy("rule").agg(F.collect_list(F.struct("item", "any")).alias("held"))
    return written(found.join(each, "rule").select(
        "rule", "tokens", F.array_sort("held")["any"].alias("alternatives"), "confidence", "support"), "rules-tokens", "snappy")


def blocked_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url of every page that has a token of each item of a rule."""
    index = rules.select("rule", F.size("tokens").alias("need"), F.posexplode("alternatives").alias("item", "any")) \
        .select("rule", "need", "item", F.explode("any").alias("token"))
    tokens = pages.select("url").where("url is not null").distinct() \
        .select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    return tokens.join(broadcast_if_small(index), "token").select("url", "rule", "need", "item").distinct() \
        .groupBy("url", "rule", "need").agg(F.count("*").alias("met")).where("met = need").select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]],
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
          page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    mined = mine(pages, labels, min_support, min_confidence, page_id=page_id)
    hit = blocked_urls(pages, mined).select(F.col("url").alias("blocked"))
    url = F.col("url")
    rows = pages.select(F.col(page_id).alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.join(broadcast_if_small(hit), F.col("url") == F.col("blocked"), "left") \
        .withColumn("own", explicit(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(
            F.col("own.verdict"), F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))
