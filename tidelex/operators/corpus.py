"""Article scans, sentence filters and corpus statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens, words
from ..sources.store import read_or_none


def articles(docs: DataFrame, langs: tuple[str, ...] = ("en", "es")) -> DataFrame:
    """(lang, doc_id, text) of the given languages."""
    return docs.where(F.col("lang").isin(*langs)).select("lang", "doc_id", "text")


def article_budget(arts: DataFrame, most: int, min_chars: int = 50) -> DataFrame:
    """The first most articles of each language by id; short ones use up the budget but are left out."""
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return arts.withColumn("article_ord", n.cast("long")).where(F.col("article_ord") <= most).where(F.length("text") >= min_chars)


def sentence_rows(arts: DataFrame) -> DataFrame:
    """(lang, doc_id, sent_ord, sentence)."""
    return arts.select("lang", "doc_id", F.posexplode(sentences(F.col("text"))).alias("sent_ord", "sentence")).withColumn("sent_ord", F.col("sent_ord").cast("long"))


def sized(rows: DataFrame, low: int = 5, high: int = 100) -> DataFrame:
    """Sentences of low to high distinct words, with these words."""
    # The test goes inside a generator, as a filter would be pushed down and find the words twice.
    found = rows.withColumn("words", words(F.col("sentence")))
    fits = F.when(F.size("words").between(low, high), F.array("words"))
    return found.select(*rows.columns, F.explode(fits).alias("words"))


def concept_hits(rows: DataFrame, word_concept: DataFrame) -> DataFrame:
    """(lang, doc_id, sent_ord, sentence, word, concept_id): a row for each distinct vocabulary word of a sentence."""
    return rows.select("lang", "doc_id", "sent_ord", "sentence", F.explode("words").alias("word")).join(word_concept, ["lang", "word"])


def concept_counts(rows: DataFrame, word_concept: DataFrame) -> DataFrame:
    """(lang, concept_id, n): how many concept_hits() rows have. Words are counted before they meet their concepts."""
    n = rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.join(word_concept, ["lang", "word"]).groupBy("lang", "concept_id").agg(F.sum("n").alias("n"))


def token_stats(docs: DataFrame) -> DataFrame:
    t = docs.select("lang", tokens(F.col("text")).alias("t"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("t")).alias("n_tokens"), F.max(F.size("t")).cast("long").alias("longest"), F.round(F.avg(F.size(F.array_distinct("t"))), 6).alias("mean_distinct"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(lang, n, k): how many documents have n tokens. Such counts of parts of a corpus add up to those of the whole."""
    n = docs.select("lang", F.size(tokens(F.col("text"))).cast("long").alias("n"))
    return n.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("k"))


def projection(counts: DataFrame, usd_per_million: float, full_docs: int) -> DataFrame:
    """counts(lang, n, k) -> mean, median and 95th nearest-rank token counts by language, and the projected price of full_docs documents."""
    g = counts.groupBy("lang", "n").agg(F.sum("k").alias("k"))
    up = F.sum("k").over(Window.partitionBy("lang").orderBy("n"))
    all_rows = F.sum("k").over(Window.partitionBy("lang"))
    g = g.withColumns({"upto": up, "all": all_rows})
    at = lambda s: F.min(F.when(F.col("upto") > F.floor(F.col("all") * F.lit(s)), F.col("n")))
    return g.groupBy("lang").agg(
        F.sum("k").alias("n_docs"), F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k").cast("double"), 6).alias("mean_tokens"), at(0.5).alias("median_tokens"), at(0.95).alias("p95_tokens"),
        F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k").cast("double") * F.lit(float(full_docs)) / F.lit(1e6) * F.lit(usd_per_million), 6).alias("usd"),
    )


def cost_projection(docs: DataFrame, usd_per_million: float, full_docs: int) -> DataFrame:
    """projection() of a corpus; ranks come from counts of values, not from collected rows."""
    return projection(token_counts(docs), usd_per_million, full_docs)


def scanned(spark: SparkSession, source: str, root: str, files_per_batch: int = 64, most_batches: int | None = None) -> DataFrame:
    """The token counts of all files of a Parquet table source(lang, text, ...), kept under root by batches of files: files that are counted already aren't read
    again, so that a scan that stopped goes on where it was. most_batches stops this call early. A batch is written under the name of its files, so a
    repeated one replaces itself; files are taken to stay as they are."""
    done = read_or_none(spark, f"{root}/counts")
    seen = set() if done is None else {r["file"] for r in done.select("file").where("file IS NOT NULL").distinct().collect()}
    files = sorted(set(spark.read.parquet(source).inputFiles()) - seen)
    for i, at in enumerate(range(0, len(files), files_per_batch)):
        if most_batches is not None and i >= most_batches:
            break
        part = files[at : at + files_per_batch]
        counts = token_counts(spark.read.parquet(*part)).withColumn("file", F.lit(None).cast("string"))
        names = spark.createDataFrame([(f,) for f in part], "file string").select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("k"), "file")
        name = hashlib.sha1("\n".join(part).encode()).hexdigest()
        counts.unionByName(names).coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/batch={name}")
    return spark.read.schema("lang string, n long, k long, file string").option("basePath", f"{root}/counts").parquet(f"{root}/counts").where("file IS NULL").groupBy("lang", "n").agg(F.sum("k").alias("k"))
