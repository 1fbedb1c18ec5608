"""Corpus pipeline: five training-data operators, each stage on all that the one before it kept.

Language ID drops undetermined documents; near-dedup keeps one document of each group (five-word
shingles, similarity 0.8); decontamination drops documents that hold a benchmark item; mixing repeats
or leaves out documents to meet the source targets; sharding exchanges what is left into 24 shards.

Rows are judged by their own text: null and repeated ids lose nothing, and a null text, having no language, is dropped first. All
stages but the last return the columns of their input; the last adds its own, and a column of a document with the name of one of
those becomes ``document_<name>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelfusion.llm.common import stored, temporary
from parcelfusion.llm.decontam import decontaminate
from parcelfusion.llm.langid import keep_identified
from parcelfusion.llm.minhash import one_of_each
from parcelfusion.llm.mixing import mixed_documents
from parcelfusion.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, shards=24, keep_columns=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained model decides in the first stage, so SQL can't express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage's result is written to the shared folder and read again; what stages wrote
    on the way is deleted after them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):
        for name, stage in STAGES[:-1]:
            with temporary(spark):
                docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", outer=1)
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), f"pipeline-{name}", outer=1)
