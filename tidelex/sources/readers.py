"""Readers with fixed schemas: dictionaries, tab-separated collections and relevance, vocabulary JSON, question sets, heads, splits."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Files

VOCAB = "map<string,struct<en:array<string>,es:array<string>>>"
QUESTIONS = "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string>>>>>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) in file order: by file name, then by place in the file."""
    each = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    return each.select(F.struct("file", "block", "row").alias("ord"), "value")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, src, tgt), lower-cased; lines of fewer than two fields are left out, further fields ignored."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return lines(spark, path).withColumn("p", parts).where(F.size("p") >= 2).select("ord", F.lower(F.col("p")[0]).alias("src"), F.lower(F.col("p")[1]).alias("tgt"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) at the first tab, further tabs stay; of equal keys the last line counts."""
    p = F.split("value", "\t", 2)
    rows = lines(spark, path).where(F.col("value") != "").select("ord", p[0].alias("key"), F.coalesce(p[1], F.lit("")).alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def relevance(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid) of four-field lines."""
    p = F.split("value", r"\s+")
    return lines(spark, path).where(F.size(p) >= 3).select(p[0].alias("qid"), p[2].alias("pid"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, en, es) of a JSON object by concept."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", VOCAB).alias("m"))
    return raw.select(F.explode("m").alias("concept_id", "w")).select("concept_id", "w.en", "w.es")


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """(lang, word, concept_id) of a JSON object of words by language."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return raw.select(F.explode("m").alias("lang", "w")).select("lang", F.explode("w").alias("word", "concept_id"))


def concept_counts(spark: SparkSession, path: str) -> DataFrame:
    """(lang, concept_id, n) of a JSON object of counts by language."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,bigint>>").alias("m"))
    return raw.select(F.explode("m").alias("lang", "c")).select("lang", F.explode("c").alias("concept_id", "n"))


def question_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries (qid, question, id), passages (id, text)) of nested question JSON; the id is the passage's SHA-1."""
    return _questions(spark.read.schema(QUESTIONS).json(path, multiLine=True))


def _questions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    p = p.select(F.sha1("p.context").alias("id"), F.col("p.context").alias("text"), "p.qas")
    return p.select("id", F.explode("qas").alias("q")).select("q.id", "q.question", F.col("id").alias("doc")).toDF("qid", "question", "id"), p.select("id", "text").dropDuplicates(["id"])


def split_ids(path: str, expected_sha256: str) -> list[str]:
    """The ids of a split file; raises if its bytes differ from the manifest's."""
    raw = Files(path).read(path)
    if (got := hashlib.sha256(raw).hexdigest()) != expected_sha256:
        raise ValueError(f"{path}: sha256 {got} differs from the manifest's {expected_sha256}")
    return json.loads(raw)


def zipped_questions(spark: SparkSession, path: str, member: str) -> tuple[DataFrame, DataFrame]:
    """question_set() of the JSON files inside zip archives whose names match a pattern; an archive is read by one task."""
    of = re.compile(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if of.search(name):
                            yield pa.RecordBatch.from_arrays([pa.array([z.read(name).decode("utf-8")])], ["value"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
    return _questions(raw.select(F.from_json("value", QUESTIONS).alias("r")).select("r.data"))


def collection(spark: SparkSession, passages: dict[str, str], queries: dict[str, str], qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus (lang, id, text), queries (lang, qid, text), relevance (lang, qid, id)) of tab-separated files by language and one file of relevance. The corpus
    is the passages that are relevant to some query; ids are SHA-1 of the texts, so equal texts are one passage, and a query stays where it has a
    relevant passage."""
    rel = relevance(spark, qrels).distinct()
    both = lambda files, key: reduce(DataFrame.unionByName, [key_values(spark, at).select(F.lit(lang).alias("lang"), F.col("key").alias(key), F.col("value").alias("text")) for lang, at in files.items()])
    found = both(passages, "pid").join(rel.select("pid").distinct(), "pid", "left_semi").withColumn("id", F.sha1("text"))
    gold = rel.join(found.select("lang", "pid", "id"), "pid").select("lang", "qid", "id").distinct()
    asked = both(queries, "qid").join(rel.select("qid").distinct(), "qid", "left_semi")
    return found.select("lang", "id", "text").dropDuplicates(["lang", "id"]), asked, gold


def with_distractors(corpus: DataFrame, passages: DataFrame, most: int) -> DataFrame:
    """corpus(lang, id, text) and the first most other passages(lang, ord, id, text) of each language; where ids clash the corpus stays."""
    rest = passages.join(corpus.select("lang", "id"), ["lang", "id"], "left_anti").groupBy("lang", "id").agg(F.min(F.struct("ord", "text")).alias("r"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("r.ord", "id"))
    return corpus.unionByName(rest.withColumn("n", n).where(F.col("n") <= most).select("lang", "id", "r.text"))
