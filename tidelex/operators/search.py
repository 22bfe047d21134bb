"""Search over postings, ranking metrics, coverage, and the checks on results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def doc_freq(postings: DataFrame) -> DataFrame:
    """postings(id, term, ...) with a row for each document and term -> (term, df)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def search(queries: DataFrame, postings: DataFrame, n_docs: int, k: int) -> DataFrame:
    """queries(qid, term, q) and postings(id, term, d) -> (qid, id, score, rank): the best k of the documents that share a term.

    Only terms that queries hold are counted and scored, and the ranking keeps k rows a query before it shuffles. Queries, a stated set, go to the postings: where these are dealt
    by id, so are the scores, and none is dealt out."""
    wanted = postings.join(queries.select("term").distinct(), "term", "left_semi")
    # Counts d, so that both readers of the postings need the same columns of them and share their shuffle.
    df = wanted.groupBy("term").agg(F.count("d").alias("df"))
    asked = queries.join(df, "term").select("qid", "term", (idf(F.lit(n_docs), F.col("df")) * F.col("q")).alias("w"))
    scores = wanted.join(F.broadcast(asked), "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("d")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def search_parts(queries: DataFrame, postings: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """queries(run, part, qid, term, q), postings(part, id, term, d) and sizes(part, n_docs) -> (run, qid, id, score, rank): search() of each
    run's queries over its part of the documents, all in one plan."""
    wanted = postings.join(queries.select("part", "term").distinct(), ["part", "term"], "left_semi")
    df = wanted.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(sizes), "part")
    hits = queries.join(wanted, ["part", "term"]).join(df, ["part", "term"])
    part = idf(F.col("n_docs"), F.col("df")) * F.col("q") * F.col("d")
    scores = hits.groupBy("run", "qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("run", "qid").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def blocks_of(rows: DataFrame, size: Callable[[Row], int], most: int) -> Iterator[list[Row]]:
    """A stated query set in blocks of a bounded size (or of one row)."""
    block, filled = [], 0
    for r in rows.toLocalIterator():
        if block and filled + size(r) > most:
            yield block
            block, filled = [], 0
        block.append(r)
        filled += size(r)
    if block:
        yield block


def containing(docs: DataFrame, items: DataFrame, block_chars: int = 1 << 20) -> DataFrame:
    """docs(id, text) and items(qid, text) -> (qid, id): documents that hold an item word for word. An automaton of a block of items reads each text
    once; empty items are in none."""
    spark, out = docs.sparkSession, None
    for block in blocks_of(items.select("qid", "text").where(F.length("text") > 0), lambda r: len(r["text"]), block_chars):
        shared = spark.sparkContext.broadcast([(r["qid"], r["text"]) for r in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            find, by = ahocorasick.Automaton(), {}
            for qid, text in shared.value:
                by.setdefault(text, []).append(qid)
            for text, qids in by.items():
                find.add_word(text, qids)
            find.make_automaton()
            for b in batches:
                got = [(q, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for q in {q for _, qs in find.iter(t) for q in qs}]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["qid", "id"])

        part = docs.select("id", "text").mapInArrow(run, "qid long, id long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "qid long, id long")


def metrics(run: DataFrame, qrels: DataFrame, qids: DataFrame, k_ndcg: int = 10, k_recall: int = 100, k_mrr: int = 10, by: tuple[str, ...] = (), places: int = 6) -> DataFrame:
    """Per query of qids: ndcg, recall and mrr over binary relevance; 0 without results or relevant documents. by: further columns that
    all three tables have, as of several runs."""
    key = [*by, "qid"]
    relevant = qrels.select(*key, "id").distinct()
    n = relevant.groupBy(*key).agg(F.count(F.lit(1)).alias("relevant"))
    hit = run.join(relevant, [*key, "id"])
    gain = F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))
    got = hit.groupBy(*key).agg(
        F.sum(F.when(F.col("rank") <= k_ndcg, gain)).alias("dcg"), F.count_if(F.col("rank") <= k_recall).alias("found"), F.min(F.when(F.col("rank") <= k_mrr, F.col("rank"))).alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("relevant"), F.lit(k_ndcg))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), places)
    return qids.select(*key).join(n, key, "left").join(got, key, "left").select(
        *key, zero(F.col("dcg") / F.when(F.col("relevant") > 0, ideal)).alias("ndcg10"), zero(F.col("found") / F.col("relevant").cast("double")).alias("r100"), zero(F.lit(1.0) / F.col("first")).alias("mrr10")
    )


def summary(per_query: DataFrame, *by: str) -> DataFrame:
    """One row (of each run): queries, and mean and population deviation of each metric."""
    out = [F.count(F.lit(1)).alias("n_queries")]
    for m in ("ndcg10", "r100", "mrr10"):
        out += [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_pop(m), F.lit(0.0)), 6).alias(f"{m}_std")]
    return per_query.groupBy(*by).agg(*out)


def tree_digest(rows: DataFrame, *by: str, bits: int = 10, levels: int = 4) -> DataFrame:
    """rows(key long, h) -> one digest (of each group): SHA-256 over the ordered digests of blocks of keys, of blocks of these, and so
    on, so that no value holds more than a block's 2**bits."""
    for level in range(levels):
        block = F.shiftright("key", bits) if level + 1 < levels else F.lit(0).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "h"))), lambda x: x["h"]), "")
        rows = rows.groupBy(*by, block.alias("up")).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("up", "key")
    return rows.select(*by, F.col("h").alias("digest"))


def rank_digest(run: DataFrame) -> DataFrame:
    """One row: the digest of each query's ranked ids, queries in order."""
    per = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))  # k rows a query
    line = F.concat(F.col("qid").cast("string"), F.lit("\x1f"), F.array_join(F.transform("r", lambda x: x["id"].cast("string")), "|"), F.lit("\x1e"))
    return tree_digest(per.select(F.col("qid").alias("key"), F.sha2(line, 256).alias("h")))


def corpus_digest(docs: DataFrame) -> DataFrame:
    """Per language: the digest of its documents' ids and texts, in the order of ids."""
    each = docs.select("lang", F.col("doc_id").alias("key"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.col("text"), F.lit("\x1e")), 256).alias("h"))
    return tree_digest(each, "lang")


def covered(query_concepts: DataFrame, gold: DataFrame, doc_concepts: DataFrame) -> DataFrame:
    """Queries that share a concept with one of their relevant documents."""
    d = gold.join(doc_concepts, "id").select("qid", "concept_id").distinct()
    return query_concepts.select("qid", "concept_id").join(d, ["qid", "concept_id"], "left_semi").select("qid").distinct()


def distractors(corpus: DataFrame, gold_ids: DataFrame, most: int) -> DataFrame:
    """The gold passages and the first most others by id."""
    gold = corpus.join(gold_ids, "id", "left_semi").withColumn("kind", F.lit("gold"))
    rest = corpus.join(gold_ids, "id", "left_anti").orderBy("id").limit(most).withColumn("kind", F.lit("distractor"))
    return gold.unionByName(rest)


def gate(report: DataFrame, wins: DataFrame, baselines: DataFrame) -> DataFrame:
    """wins(pair, metric, name): what a report must beat strictly; a missing baseline passes."""
    j = wins.join(report, ["pair", "metric"], "left").join(baselines.withColumnRenamed("value", "bar"), ["pair", "metric", "name"], "left")
    return j.select("pair", "metric", "name", "value", "bar", F.coalesce(F.col("value") > F.col("bar"), F.lit(True)).alias("passed"))


def deltas(report: DataFrame, baselines: DataFrame) -> DataFrame:
    j = report.join(baselines.withColumnRenamed("value", "bar"), ["pair", "metric"])
    return j.select("pair", "metric", "name", F.round(F.col("value") - F.col("bar"), 6).alias("delta"))


def hash_split(qids: DataFrame, dev: int, val: int, seed: str) -> DataFrame:
    """(pair, qid, split, ord): queries in the order of a seeded hash, cut into dev, validation and test."""
    h = F.sha2(F.concat_ws("::", F.lit(seed), "pair", F.col("qid").cast("string")), 256)
    n = F.row_number().over(Window.partitionBy("pair").orderBy(h, "qid")).cast("long")
    s = qids.withColumn("n", n)
    name = F.when(F.col("n") <= dev, "dev").when(F.col("n") <= dev + val, "validation").otherwise("test")
    at = F.when(F.col("n") <= dev, F.col("n")).when(F.col("n") <= dev + val, F.col("n") - dev).otherwise(F.col("n") - dev - val)
    return s.select("pair", "qid", name.alias("split"), at.alias("ord"))


def carved(splits: DataFrame, chosen: DataFrame) -> DataFrame:
    """splits(qid, pair, split, ord) and chosen(qid) -> (qid, split, ord) of the chosen queries; of a query's entries the last counts, test after
    validation, then by pair."""
    last = F.struct((F.col("split") == "test").alias("t"), "pair")
    kept = splits.groupBy("qid").agg(F.max_by(F.struct("split", "ord"), last).alias("s"))
    return chosen.join(kept, "qid").select("qid", "s.split", "s.ord")


def card_rows(report: DataFrame, baselines: DataFrame) -> DataFrame:
    """report(pair, metric, value) -> a row for each comparator of a metric, or one without, with difference and verdict."""
    j = report.join(baselines.select("pair", "metric", F.col("name").alias("comparator"), F.col("value").alias("bar")), ["pair", "metric"], "left")
    return j.select("pair", "metric", "value", "comparator", "bar", F.round(F.col("value") - F.col("bar"), 6).alias("delta"), (F.col("value") > F.col("bar")).alias("better"))


def bootstrap(per_query: DataFrame, draws: int = 1000) -> DataFrame:
    """One row: mean difference a - b, its 95 % interval and two-sided p, by Poisson resampling weights from hashes
    (each query counts 0, 1, 2, ... times in a draw), so draws add up without moving rows."""
    h = F.sha1(F.concat(F.col("qid").cast("string"), F.lit(":"), F.col("draw").cast("string")))
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    weight = sum((F.when(u > F.lit(x), 1).otherwise(0) for x in POISSON[1:]), F.when(u > F.lit(POISSON[0]), 1).otherwise(0))
    each = per_query.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = each.groupBy("draw").agg(F.round(F.sum(F.col("w") * (F.col("a") - F.col("b"))) / F.greatest(F.sum("w"), F.lit(1)), 9).alias("d"))
    point = per_query.agg(F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"))
    at = lambda q: F.round(F.percentile("d", F.lit(q)), 6)
    tails = means.agg(at(0.025).alias("low"), at(0.975).alias("high"), F.round(F.least(F.lit(1.0), F.lit(2.0) * F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))), 6).alias("p"))
    return point.withColumn("one", F.lit(1)).join(tails.withColumn("one", F.lit(1)), "one").drop("one")


#: The chance that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8))
