"""From raw documents to packed training sequences.

Five stages, each an operator of ``newsweave.llm`` over all that the stage
before it kept: language ID, exact deduplication, n-gram Jaccard join, mixing
sources to target weights, packing. Every stage's result is written as Parquet
to the shared folder and read again, so a lost executor never goes back
further than one stage.

All stages but the last return the columns of their input. Rows keep nulls,
empty and repeated texts as the operators define it: a text without letters is
rejected by the first stage (null and empty ones with it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import centroid_langid, hash_mix, online_packing, stream_dedup, trie_join
from newsweave.llm.common import free_names, load, shared_path, written
from newsweave.llm.queries import vocabulary_path
from newsweave.session import broadcast_if_small


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are like no learned language."""
    model = centroid_langid.fit(docs, F.lit(True))
    # Numbered columns clash with none that predict adds, and each text travels once.
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text") if "text" in names else [c.lower() for c in names].index("text")
    kept = centroid_langid.predict(rows, model, f"c{at}").where("not rejected")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    path = shared_path(spark, "arrived")
    docs.write.parquet(path)
    gone = stream_dedup.deduplicate(spark, path).where("not kept").select("place")
    rows = spark.read.parquet(path)
    at, = free_names(docs, "place")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select("*", place.alias(at)) \
        .join(broadcast_if_small(written(gone, "gone").withColumnRenamed("place", at)), at, "left_anti").drop(at)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles: five words, and a
    similarity of 0.8 or more."""
    row, = free_names(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = trie_join.similar(rows.select(row, "text"), n=5, percent=80, id_col=row)
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "gone")
    return rows.join(broadcast_if_small(gone), row, "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return hash_mix.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequences they are in."""
    return online_packing.pack(docs, vocabulary_path(), end_id=1)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the centroids nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
