"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing; counted as part of the llm folder.

Each stage gives rows of the table it gets, with the table's own columns whatever their names; the last one may repeat rows. Null and empty texts
are clean, equal to each other, near each other, and without words, so that the mixture takes none of them; rows with
null ids are rows of their own, which stay where no row with an id is equal or near; of ties and repeated rows one stays, the same one in any order of rows. An
empty table gives an empty one. Without labels nothing is toxic, without benchmark items nothing leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelex.llm import decontam, exact_dedup, mixing, simhash, toxicity
from tidelex.llm.common import new_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Learned scores and edit matching aren't SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = new_dir(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
    return docs
