"""From documents to token shards: language ID, near-duplicate removal, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next one's docs. Document ids are taken to be unique; rows that repeat id and text count once from the
second stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import decontaminate, jaccard, language, mixing, sstable
from turnstone.llm.bloom import without_named
from turnstone.llm.common import shared_dir, stage_table, table

#: Rows of an Arrow batch in all stages: whole documents pass through Python, and Spark and Python hold a batch each.
BATCH_ROWS = 1000
#: A document whose words have no language at this share of them is rejected, as is one without any word.
LEAST_SCORE = 0.35


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language."""
    _short_batches(spark)
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link, keeps the one of the smallest id.

    Documents that go are told by id, so that texts need no shuffle; only rows whose id is there several times meet by text.
    """
    _short_batches(spark)
    groups = stage_table(jaccard.jaccard_groups(docs.select("doc_id", "text")))
    gone = stage_table(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = without_named(docs, "doc_id", gone)
    if groups.where("doc_id IS NULL").limit(1).count() and not groups.where("doc_id IS NULL AND component_id IS NULL").limit(1).count():
        kept = kept.where("doc_id IS NOT NULL")
    again = stage_table(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    repeated = kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return without_named(kept, "doc_id", again).where("doc_id IS NOT NULL").unionByName(repeated.where("doc_id IS NOT NULL")).unionByName(kept.where("doc_id IS NULL").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    _short_batches(spark)
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mixture takes, each once."""
    taken = mixing.mix(mixing.with_levels(docs), epochs=1).select(F.col("doc_id").alias("__taken")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["__taken"]), "left_semi")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes sorted shards of token ids; returns what reads back from them, a row per document."""
    _short_batches(spark)
    path = shared_dir(spark)
    manifest = sstable.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True)
    return sstable.digest(sstable.read_shards(spark, path, manifest))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_to_weights),
    ("token output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs)
    return docs


#: A conditional random field isn't SQL's to express; the tests compare the stages with brute force.
ORACLE_SQL = None
