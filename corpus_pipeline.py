"""From documents to sharded training data, in five stages that each apply one operator to all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages that send whole texts to Python lower the session's rows a batch and leave it so, as their result is computed by whoever reads it; `run` brings the
caller's setting back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronotag.llm import decontam, jaccard, langid, mixing, shards
from chronotag.llm.common import pinned, small_batches, table


def few_rows_a_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows from here on in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier reads as the language they are labelled with, or without a label; texts without letters go."""
    few_rows_a_batch(spark)
    return langid.keep(docs, langid.fit(docs), label="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 80 % of their five-word shingles, directly or through others."""
    return jaccard.keep_first(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    few_rows_a_batch(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in the order of the curriculum."""
    return mixing.copies(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard of its doc_id."""
    return shards.place(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shard", shard)]

#: Learned weights, hashes and similarity joins are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for _, stage in STAGES[:-1]:
            docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
