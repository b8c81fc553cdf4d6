"""Physical-plan properties the scale design relies on."""

from newsweave.plans import pipeline as pl
from newsweave.plans import queries as Q

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_filter_reaches_the_scan(spark):
    p = plan(Q.q_scan_range(spark, SF_SMALL))
    assert "GreaterThanOrEqual(date,2024-01-10T07:00)" in p and "LessThan(date,2024-01-12T12:00)" in p
    assert "PartitionFilters: [isnotnull(digest_date" in p            # only the slots of the range


def test_scan_reads_only_needed_columns(spark):
    p = plan(Q.q_scan_range(spark, SF_SMALL))
    assert "ReadSchema: struct<agency:string,index:bigint,date:timestamp_ntz>" in p     # no text
    assert p.count("FileScan") == 1


def test_slot_range_is_one_scan(spark):
    p = plan(Q.q_slot_range(spark, SF_SMALL))
    assert p.count("FileScan") == 1 and "GreaterThanOrEqual(date" in p


def test_stories_never_read_the_texts_again(spark):
    for fn in (Q.q_digest_lines, Q.q_digest_text, Q.q_day_digest, Q.q_cluster_links, Q.q_token_vectors):
        assert "documents.parquet" not in plan(fn(spark, SF_SMALL))


def test_summaries_deal_the_texts_once(spark):
    from newsweave.operators.summarise import summaries
    p = plan(summaries(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    assert p.count("Exchange hashpartitioning") <= 2 and "Exchange hashpartitioning(doc_id#" in p


def test_one_read_of_the_texts_to_train(spark):
    from newsweave.operators.classify import train_nb
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    assert "FileScan" in plan(train_nb(docs, labels).table) and "documents.parquet" not in plan(train_nb(docs, labels).table)


def test_top_n_is_limited_before_the_shuffle(spark):
    p = plan(Q.q_top_clusters(spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_latest_settings_is_an_aggregate_not_a_window(spark):
    p = plan(Q.q_latest_settings(spark, SF_SMALL))
    assert "Window" not in p
    assert "partial_max" in p


def test_story_numbering_has_no_per_slot_window(spark):
    # numbered by a global sort + per-partition offsets, not row_number per slot
    p = plan(Q.q_story_order(spark, SF_SMALL))
    assert "row_number()" not in p and "_off" in p


def test_pair_join_is_grouped_per_block_pair(spark):
    p = plan(pl.pairs(spark, SF_SMALL))
    assert "FlatMapGroupsInPandas" in p and "_lo" in p and "_hi" in p


def test_summaries_sort_no_words(spark):
    from newsweave.operators.summarise import summaries
    p = plan(summaries(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    assert "Window" not in p and "Sort" not in p and "Generate" not in p


def test_day_digests_parse_the_commands_once(spark):
    assert "events.parquet" not in plan(Q.q_day_digest(spark, SF_SMALL))
