"""Headline-query benchmark.

/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``; each query is executed to
completion with the ``noop`` sink (all columns computed, nothing collected),
one warm-up then the median of ``$BENCH_REPEAT`` (default 3) runs. Prints one
JSON line.

``article_vectors``, ``similar_pairs`` and ``story_clusters`` start from the
written article table and rebuild everything behind it on every run (vectors,
pair join, all merge rounds). ``summarise`` reads the whole texts, as the
article table does once. ``digest_lines`` reads the written story table like
the production digest job does (stories are clustered once per slot).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from newsweave import fixtures as fx  # noqa: E402
from newsweave.operators import clusters, vectors  # noqa: E402
from newsweave.plans import pipeline as pl  # noqa: E402
from newsweave.plans import queries as Q  # noqa: E402
from newsweave.session import build_session, read_table  # noqa: E402


def _vectors(spark, d):
    return pl.vectors_of(fx.articles(spark, d), read_table(spark, d, "embeddings"))


def _article_vectors(spark, d):
    return _vectors(spark, d).select("index", F.posexplode("vec").alias("dim", "value"))


def _similar_pairs(spark, d):
    nodes = clusters.view_nodes(pl.view_articles(spark, d), _vectors(spark, d))[1]
    return vectors.similar_pairs(nodes.where(F.col("vec").isNotNull()))


def _story_clusters(spark, d):
    s = pl.stories_of(pl.view_articles(spark, d), _vectors(spark, d))
    return s.select("digest_date", "part", "index", "cid", "size", "label")


HEADLINE = {
    "slot_assign": Q.q_slot_assign,
    "summarise": Q.q_summarise,
    "article_vectors": _article_vectors,
    "similar_pairs": _similar_pairs,
    "story_clusters": _story_clusters,
    "latest_settings": Q.q_latest_settings,
    "digest_lines": Q.q_digest_lines,
    "classify_nb": Q.q_classify_nb,
    "stream_slots": Q.q_stream_slots,
}


def run_once(spark, fn, d) -> float:
    t0 = time.perf_counter()
    fn(spark, d).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = os.environ.get("BENCH_ONLY")
    spark = build_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")),
                          app="newsweave-bench")
    results: dict[str, float] = {}
    for name, fn in HEADLINE.items():
        if only and name not in only.split(","):
            continue
        run_once(spark, fn, sf_dir)  # warm-up (and persist stories once)
        times = [run_once(spark, fn, sf_dir) for _ in range(repeat)]
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]}s {times}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_median", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
