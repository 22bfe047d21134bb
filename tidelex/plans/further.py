"""Queries for the operators around training data, evaluation and diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, label_of, name_uuid, tokens
from ..functions.vector import dot, head, norm
from ..operators import corpus, encode, graph, sample, search, vectors, vocab
from ..sources.store import shared_dir
from ..streaming import ingest
from . import retrievers
from .base import Base
from .catalog import _BARS_SQL, _DEMAND, _PLACED, _POOL, _REPORT, _SENSE_SQL, _report, long, sense_of
from .register import SQL, query
from .registry import HashedGrams
from .training import INPUT, LEARNED, digest_sql, unit_sql

# Vocabulary -------------------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS concepts, sum(size)::BIGINT AS words, count(*) FILTER (ok) AS concepts_kept, coalesce(sum(size) FILTER (ok), 0)::BIGINT AS words_kept,
  round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS kept_pct, round(100.0::DOUBLE * coalesce(sum(size) FILTER (ok), 0) / sum(size), 1) AS words_pct FROM (SELECT *, least(en_n, es_n) >= 50 AS ok FROM supply)""", "supply")
def prune_report(b: Base) -> DataFrame:
    return vocab.prune_stats(b.vocab, vocab.prune(b.vocab, b.counts, 50))


def _pools(b: Base) -> DataFrame:
    return b.table("benchmark").select(vocab.pool(F.col("item_id")).alias("pool"), F.explode(tokens(F.col("text"))).alias("word"))


@query(f"""SELECT pool, count(*) AS tokens, any_value(coalesce(m, 0)) AS matched, round(any_value(coalesce(m, 0)) / count(*)::DOUBLE, 6) AS ceiling
  FROM (SELECT {_POOL} AS pool, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM benchmark) LEFT JOIN (SELECT pool, count(*) AS m FROM dm GROUP BY 1) USING (pool) GROUP BY 1""", "wc", also=_DEMAND)
def demand_ceiling(b: Base) -> DataFrame:
    words = _pools(b)
    return vocab.demand_ceiling(words, words.join(b.word_concept, "word"))


@query("SELECT concept_id, demand, n AS place FROM (SELECT *, sum(demand) OVER o AS cum, count(*) OVER o AS n, sum(demand) OVER () AS total FROM need WINDOW o AS (ORDER BY demand DESC, concept_id ROWS UNBOUNDED PRECEDING)) WHERE cum - demand < 0.9::DOUBLE * total", "wc", also=_DEMAND)
def demand_selection(b: Base) -> DataFrame:
    return vocab.demand_choice(vocab.demand(_pools(b).join(b.word_concept, "word")), 0.9)


@query("""SELECT count(*) AS parts, round(avg(density), 6) AS mean, round(quantile_cont(density, 0.5), 6) AS median, round(quantile_cont(density, 0.1), 6) AS p10 FROM (
  SELECT round(any_value(coalesce(k, 0)) / (count(*) FILTER (node LIKE 'en:%') * count(*) FILTER (node LIKE 'es:%'))::DOUBLE, 6) AS density
  FROM part LEFT JOIN (SELECT a.component AS c, count(*) AS k FROM edge JOIN part a ON a.node = u JOIN part z ON z.node = v WHERE a.component = z.component GROUP BY 1) ON c = component
  GROUP BY component HAVING count(*) FILTER (node LIKE 'en:%') > 0 AND count(*) FILTER (node LIKE 'es:%') > 0)""", "edge", "part")
def density_stats(b: Base) -> DataFrame:
    return graph.density_stats(b.edges, b.parts)


@query("SELECT concept_id, size, (SELECT count(*) FROM wc WHERE wc.concept_id = concept.concept_id) AS words FROM concept WHERE substr(concept_id, 3)::INT % 7 = 3", "concept", "wc")
def filtered_vocab(b: Base) -> DataFrame:
    ids = b.vocab.where(F.substring("concept_id", 3, 20).cast("long") % 7 == 3).select("concept_id")
    some, words, _ = vocab.select_ids(b.vocab, b.word_concept, ids)
    return some.select("concept_id", "size").join(words.groupBy("concept_id").agg(F.count(F.lit(1)).alias("words")), "concept_id")


@query("SELECT concept_id, left(en[1], 6) || ' / ' || left(es[1], 6) AS label FROM concept", "concept")
def concept_labels(b: Base) -> DataFrame:
    return b.vocab.select("concept_id", label_of(F.col("en"), F.col("es"), 6).alias("label"))


@query("SELECT concept_id, sum(n)::BIGINT AS n FROM counts GROUP BY 1 ORDER BY n DESC, concept_id LIMIT 30", "counts")
def frequent_concepts(b: Base) -> DataFrame:
    return b.counts.groupBy("concept_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "concept_id").limit(30)


@query("SELECT concept_id FROM counts WHERE lang = 'en' UNION SELECT concept_id FROM counts WHERE lang = 'es'", "counts")
def concept_union(b: Base) -> DataFrame:
    return b.counts.where(F.col("lang").isin("en", "es")).select("concept_id").distinct()


def _suite_sql(name: str, parts: str) -> str:
    return f"""SELECT '{name}' AS name, (SELECT count(*) FROM {parts}) AS nodes, round(sum(i) / m - sum(k::DOUBLE * k) / (4.0::DOUBLE * m * m), 6) AS modularity,
      (SELECT round(avg((a.component IS NOT DISTINCT FROM z.component AND a.component IS NOT NULL)::INT), 6) FROM edge LEFT JOIN {parts} a ON a.node = u LEFT JOIN {parts} z ON z.node = v) AS recall FROM (
      SELECT part, sum(k) AS k, sum(i) AS i FROM (
        SELECT coalesce(a.component, u) AS part, weight AS k, CASE WHEN coalesce(a.component, u) = coalesce(c.component, v) THEN weight ELSE 0 END AS i FROM edge LEFT JOIN {parts} a ON a.node = u LEFT JOIN {parts} c ON c.node = v
        UNION ALL SELECT coalesce(c.component, v), weight, 0 FROM edge LEFT JOIN {parts} c ON c.node = v) GROUP BY 1), (SELECT sum(weight)::DOUBLE AS m FROM edge) GROUP BY m"""


_ATTACHED = _PLACED + ", attached AS (FROM placed UNION ALL FROM a UNION ALL FROM z)"


@query(f"{_suite_sql('whole', 'part')} UNION ALL {_suite_sql('cut', 'placed')} UNION ALL {_suite_sql('attached', 'attached')}", "edge", "part", "top", also=_ATTACHED)
def partition_suite(b: Base) -> DataFrame:
    """Three partitions side by side: the communities, these without some words, and with orphans attached to them again."""
    some = b.parts.where(~F.col("node").endswith("a"))
    again = graph.cut(some.unionByName(vocab.attach_orphans(b.dictionary, some).select("node", "component")))
    return graph.compare(b.edges, {"whole": b.parts, "cut": some, "attached": again}).select("name", "nodes", "modularity", "recall")


def _probe_sql(name: str, parts: str) -> str:
    return f"""SELECT '{name}' AS name, w.node, w.degree, z.size, CASE WHEN z.size IS NOT NULL THEN (SELECT count(*) FROM near n JOIN {parts} o ON o.node = n.other WHERE n.node = w.node AND o.component = p.component) END AS inside
      FROM probes w LEFT JOIN {parts} p ON p.node = w.node LEFT JOIN (SELECT component, count(*) AS size FROM {parts} GROUP BY 1) z ON z.component = p.component"""


_PROBES = _ATTACHED + """, near AS (SELECT u AS node, v AS other FROM edge UNION SELECT v, u FROM edge), probes AS (SELECT node, count(*) AS degree FROM near GROUP BY 1 ORDER BY degree DESC, node LIMIT 20)"""


@query(f"{_probe_sql('whole', 'part')} UNION ALL {_probe_sql('cut', 'placed')} UNION ALL {_probe_sql('attached', 'attached')}", "edge", "part", "top", also=_PROBES)
def polysemy_probe(b: Base) -> DataFrame:
    """The 20 words of most translations, and where three partitions put them."""
    some = b.parts.where(~F.col("node").endswith("a"))
    again = graph.cut(some.unionByName(vocab.attach_orphans(b.dictionary, some).select("node", "component")))
    ends = b.edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return graph.probe(b.edges, ends.orderBy(F.desc("degree"), "node").limit(20), {"whole": b.parts, "cut": some, "attached": again})


_SENSE_SUMS = f"sv AS (SELECT bucket, {unit_sql('d')} AS x FROM (SELECT bucket, {digest_sql('sentence', 16)} AS d FROM ({_SENSE_SQL}))), ss AS (SELECT bucket, count(*) AS n, [{', '.join(f'sum(x[{i}])' for i in range(1, 17))}] AS t FROM sv GROUP BY 1)"


@query("""SELECT a.bucket AS bucket_a, b.bucket AS bucket_b, CASE WHEN a.bucket = b.bucket THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs,
  round(CASE WHEN a.bucket = b.bucket THEN (list_dot_product(a.t, a.t) - a.n) / (a.n * (a.n - 1))::DOUBLE ELSE list_dot_product(a.t, b.t) / (a.n * b.n)::DOUBLE END, 5) AS mean
  FROM ss a JOIN ss b ON a.bucket <= b.bucket WHERE a.bucket <> b.bucket OR a.n > 1""", "sents", also=_SENSE_SUMS)
def sense_matrix(b: Base) -> DataFrame:
    """Mean similarity of sentences within each sense and between each two."""
    s = b.sents.select(sense_of().alias("bucket"), "sentence")
    x = INPUT.embed(s.select(F.col("sentence").alias("text"))).withColumnRenamed("text", "sentence")
    return vectors.bucket_matrix(s.join(x, "sentence"), "bucket").withColumn("mean", F.round("mean", 5))


@query()
def schedule_verdict(b: Base) -> DataFrame:
    """Louvain by how resolution rises for parts that are too large: parts, words by depth, undivided parts, modularity, and the tally."""
    return graph.schedules(b.edges, b.whole, {"linear": graph.linear(0.5), "exponential": graph.exponential(2.0)}, most=3)


# Stored rows --------------------------------------------------------------------------------------------------------------


@query("""SELECT p.id, p.lang, p.concept_id, '' AS focal FROM (SELECT DISTINCT id, lang, concept_id FROM points) p JOIN (
  SELECT concept_id, lang, id FROM (SELECT DISTINCT concept_id, lang, id FROM points) QUALIFY row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) <= 6) k USING (concept_id, lang, id)""", "points")
def bucket_lookup(b: Base) -> DataFrame:
    """Stored rows by lists of ids for each concept and language, six at most of each."""
    points = graph.cut(b.points.select("id", "lang", "concept_id"))  # read twice
    return sample.lookup(points, sample.buckets(points, 6)).select("id", "lang", "concept_id", "focal")


@query(f"""SELECT concept_id, lang, array_to_string(list(id ORDER BY id), ' ') AS ids FROM (SELECT * FROM (
    SELECT DISTINCT w.concept_id, s.lang, s.id FROM (SELECT DISTINCT id, lang, unnest(regexp_extract_all(lower(sentence), '{TOKEN}')) AS token FROM points) s JOIN wc w ON w.lang = s.lang AND w.word = s.token)
  QUALIFY row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) <= 10) GROUP BY 1, 2""", "points", "wc")
def rematch(b: Base) -> DataFrame:
    """The concepts that fire on stored sentences: ten ids at most of each concept and language."""
    rows = b.points.select("id", "lang", F.explode(F.array_distinct(tokens(F.col("sentence")))).alias("token")).distinct()
    return sample.buckets(encode.matches(rows, b.word_concept), 10).select("concept_id", "lang", F.array_join("ids", " ").alias("ids"))


@query("SELECT lang, sentence, min(doc_id) AS doc_id, array_to_string(list(DISTINCT word || '=' || concept_id ORDER BY word || '=' || concept_id), ' ') AS pairs FROM capped GROUP BY 1, 2", "capped")
def buffer_merge(b: Base) -> DataFrame:
    m = ingest.merged(b.capped)
    pair = F.transform(F.map_entries("pairs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("lang", "sentence", "doc_id", F.array_join(F.array_sort(pair), " ").alias("pairs"))


@query("""SELECT id, concept_id, row_number() OVER (PARTITION BY concept_id ORDER BY id, rank) - 1 AS idx FROM (SELECT *, list_position(list_transform(regexp_split_to_array(regexp_replace(sentence, '^\\s+|\\s+$', '', 'g'), '\\s+'),
  lambda w: lower(regexp_replace(w, '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g'))), word) AS k FROM points) WHERE k > 0""", "points")
def located_rows(b: Base) -> DataFrame:
    """Rows whose word is found among the sentence's, with numbers that run through again."""
    rows = sample.located(b.points)
    return rows.select("id", "concept_id", "idx")


@query("""SELECT concept_id, any_value(before) AS n_before, count(*) AS n_after FROM (SELECT *, count(*) OVER (PARTITION BY concept_id) AS before FROM latest) WHERE doc_id % 3 <> 0 AND before >= 10 GROUP BY 1 HAVING count(*) >= 10""", "latest")
def trainable_concepts(b: Base) -> DataFrame:
    """Concepts with ten rows before preparation, and still after it (here: after every third article is left out)."""
    return sample.trainable(b.latest, b.latest.where("doc_id % 3 <> 0"), 10)


@query("SELECT 3000000 + a.id AS id, v.id AS source, v.lang, v.concept_id, round(list_sum(v.x), 6) AS total FROM vec v JOIN (SELECT id FROM vec WHERE id % 3 = 0) a ON a.id = v.id", "vec")
def augmented_rows(b: Base) -> DataFrame:
    """Augmented rows take vector, language and concept of the row they were made from."""
    made = b.vec.where("id % 3 = 0").select((F.col("id") + long(3_000_000)).alias("id"), F.col("id").alias("source"))
    return sample.teacher_copies(made, b.vec).select("id", "source", "lang", "concept_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query()
def coupled_fetch(b: Base) -> DataFrame:
    """One row a sentence: its first word whose concept and whose own cap are both open still."""
    return sample.coupled(b.hits, per_concept=10, per_word=4, docs=b.arts.select("doc_id"))


# Retrieval and evaluation --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT qid, token FROM qword", "qword")
def content_tokens(b: Base) -> DataFrame:
    return b.query_tokens.select(F.col("id").alias("qid"), "token").distinct()


_NAMESPACE = "unhex('6ba7b8109dad11d180b400c04fd430c8')"


@query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
  FROM (SELECT doc_id, sha1({_NAMESPACE} || encode(doc_id::VARCHAR)) AS h FROM documents)""")
def point_uuids(b: Base) -> DataFrame:
    return b.docs.select("doc_id", name_uuid(F.col("doc_id").cast("string")).alias("id"))


@query("SELECT sha1(text) AS passage_id, arg_min(source, (doc_id, source)) AS source, count(*) AS copies FROM documents WHERE lang IN ('en', 'es') GROUP BY 1")
def corpora_union(b: Base) -> DataFrame:
    """Passages of several configurations as one corpus: equal texts are one passage, of the configuration that has it first."""
    each = b.docs.where("lang IN ('en', 'es')").select(F.sha1("text").alias("passage_id"), "doc_id", "source")
    return each.groupBy("passage_id").agg(F.min_by("source", F.struct("doc_id", "source")).alias("source"), F.count(F.lit(1)).alias("copies"))


_SPLIT = """SELECT pair, qid, CASE WHEN n <= 10 THEN 'dev' WHEN n <= 20 THEN 'validation' ELSE 'test' END AS split, CASE WHEN n <= 10 THEN n WHEN n <= 20 THEN n - 10 ELSE n - 20 END AS ord FROM (
  SELECT pair, item_id AS qid, row_number() OVER (PARTITION BY pair ORDER BY sha256('42::' || pair || '::' || item_id::VARCHAR), item_id) AS n FROM benchmark, (VALUES ('eng-eng'), ('eng-spa')) p(pair))"""


def _splits(b: Base) -> DataFrame:
    return search.hash_split(b.table("benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(F.lit("eng-eng"), F.lit("eng-spa"))).alias("pair")), 10, 10, "42")


@query("SELECT qid, pair FROM s WHERE split = 'validation' UNION ALL SELECT qid, pair FROM s WHERE split = 'test'", also=f"s AS ({_SPLIT})")
def heldout_queries(b: Base) -> DataFrame:
    """Validation and test queries of all pairs; a query of two pairs comes twice."""
    s = _splits(b)
    return s.where("split = 'validation'").select("qid", "pair").unionAll(s.where("split = 'test'").select("qid", "pair"))


@query("SELECT c.qid, u.split, u.ord FROM (SELECT item_id AS qid FROM benchmark WHERE item_id % 2 = 0) c JOIN (SELECT qid, split, ord FROM s WHERE split IN ('validation', 'test') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY split = 'test' DESC, pair DESC) = 1) u USING (qid)", also=f"s AS ({_SPLIT})")
def carved_view(b: Base) -> DataFrame:
    """Chosen queries among validation and test ones; where a query is in several, the later entry (test, then the later pair) counts."""
    return search.carved(_splits(b).where("split <> 'dev'"), b.table("benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("qid")))


@query("SELECT lang, count(*) AS n_docs, count(*) FILTER (doc_id IN (SELECT id FROM gold)) AS n_gold, count(*) FILTER (doc_id NOT IN (SELECT id FROM gold)) AS n_others FROM documents GROUP BY 1", "gold")
def corpus_counts(b: Base) -> DataFrame:
    g = b.gold.select(F.col("id").alias("doc_id"), F.lit(1).alias("g")).distinct()
    return b.docs.select("lang", "doc_id").join(g, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count("g").alias("n_gold"), F.count_if(F.col("g").isNull()).alias("n_others"))


_PAIRS = "pair AS (FROM (VALUES ('eng-eng', 'en', 'en'), ('spa-spa', 'es', 'es'), ('eng-spa', 'en', 'es'), ('spa-eng', 'es', 'en')) t(pair, ql, dl))"
_EVAL = _PAIRS + """, rel AS (SELECT p.pair, g.qid, g.id FROM gold g JOIN documents d ON d.doc_id = g.id JOIN pair p ON p.dl = d.lang), sizes AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY 1),
  posts AS (SELECT 'bm25' AS kind, id, lang, term, d FROM dpost UNION ALL SELECT 'lexical', id, lang, term, d FROM lex
    UNION ALL SELECT 'learned', v.id, d.lang, idx::VARCHAR, value FROM hvec v JOIN documents d ON d.doc_id = v.id), df AS (SELECT kind, lang, term, count(*) AS df FROM posts GROUP BY ALL),
  asked AS (SELECT 'bm25' AS kind, p.pair, p.dl, q.qid, q.term, 1.0::DOUBLE AS q FROM qterm q, pair p UNION ALL
    SELECT 'lexical', p.pair, p.dl, q.qid, q.term, CASE WHEN p.ql <> p.dl AND q.term LIKE 't:%' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END FROM lexq q JOIN pair p ON p.ql = q.ql UNION ALL
    SELECT 'learned', p.pair, p.dl, q.qid, q.idx::VARCHAR, CASE WHEN p.ql <> p.dl AND words THEN 0.5::DOUBLE ELSE q.value END FROM hqvec q JOIN pair p ON p.ql = q.ql UNION ALL
    SELECT DISTINCT 'translate-bm25', p.pair, p.dl, q.qid, s.stem, 1.0::DOUBLE FROM qword q JOIN pair p ON p.ql <> p.dl LEFT JOIN transd t ON t.src = token AND t.dir = p.ql || '-' || p.dl JOIN trstem s ON s.token = coalesce(tgt, q.token)),
  ranks AS (SELECT kind, pair, qid, id, row_number() OVER (PARTITION BY kind, pair, qid ORDER BY score DESC, id) AS rank FROM (
    SELECT a.kind, a.pair, a.qid, p.id, round(sum(ln(1.0::DOUBLE + (n_docs - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * a.q * p.d), 6) AS score FROM asked a JOIN posts p ON p.kind = replace(a.kind, 'translate-', '') AND p.lang = a.dl AND p.term = a.term
    JOIN df f ON f.kind = p.kind AND f.lang = p.lang AND f.term = p.term JOIN sizes z ON z.lang = a.dl GROUP BY ALL) QUALIFY rank <= 100),
  per AS (SELECT k.kind, n.pair, n.qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg10, round(coalesce(found / relevant::DOUBLE, 0), 6) AS r100, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr10
    FROM (SELECT DISTINCT kind, pair FROM asked) k JOIN (SELECT pair, qid, count(*) AS relevant, list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) for i in range(1, least(count(*), 10) + 1)]) AS ideal FROM rel GROUP BY 1, 2) n USING (pair)
    LEFT JOIN (SELECT r.kind, r.pair, r.qid, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 10) AS dcg, count(*) AS found, min(rank) FILTER (rank <= 10) AS first FROM ranks r JOIN rel g ON g.pair = r.pair AND g.qid = r.qid AND g.id = r.id GROUP BY 1, 2, 3) h
      ON h.kind = k.kind AND h.pair = n.pair AND h.qid = n.qid)"""


@query("""SELECT kind AS retriever, pair, count(*) AS n_queries, round(avg(ndcg10), 6) AS ndcg10_mean, round(stddev_pop(ndcg10), 6) AS ndcg10_std, round(avg(r100), 6) AS r100_mean, round(stddev_pop(r100), 6) AS r100_std,
  round(avg(mrr10), 6) AS mrr10_mean, round(stddev_pop(mrr10), 6) AS mrr10_std FROM per GROUP BY 1, 2""", "dpost", "lex", "qterm", "lexq", "qword", "transd", "trstem", "gold", "dterm", "wc", "idx", "qstem", also=LEARNED + ", " + _EVAL)
def eval_pairs(b: Base) -> DataFrame:
    """All registered retrievers on all language pairs that they support, queries with a relevant document in the pair's language."""
    return retrievers.evaluate(b)


@query(f"""SELECT r.pair, r.metric, r.value, t.name AS comparator, t.bar, round(r.value - t.bar, 6) AS delta, r.value > t.bar AS better FROM ({_REPORT}) r LEFT JOIN {_BARS_SQL} USING (pair, metric)""")
def card_rows(b: Base) -> DataFrame:
    return search.card_rows(*_report(b))


# Vectors -------------------------------------------------------------------------------------------------------------------


@query("""SELECT concept_id, lang_a = lang_b AS same_lang, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90
  FROM (SELECT *, 1.0::DOUBLE - dist AS s FROM pairs WHERE a < b) GROUP BY 1, 2""", "pairs")
def similarity_stats(b: Base) -> DataFrame:
    return vectors.similarity_stats(vectors.pairs(b.vec))


_COS = "list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))"


@query(f"SELECT a.concept_id AS bucket_a, b.concept_id AS bucket_b, count(*) AS n_pairs, round(avg({_COS}), 6) AS mean FROM allvec a JOIN allvec b ON a.concept_id < b.concept_id OR (a.concept_id = b.concept_id AND a.id < b.id) GROUP BY 1, 2", "allvec")
def bucket_matrix(b: Base) -> DataFrame:
    return vectors.bucket_matrix(b.all_vec)


@query("SELECT round(min(mean) FILTER (bucket_a = bucket_b), 6) AS least_intra, round(max(mean) FILTER (bucket_a <> bucket_b), 6) AS most_cross, round(min(mean) FILTER (bucket_a = bucket_b) - max(mean) FILTER (bucket_a <> bucket_b), 6) AS gap FROM m", "allvec",
       also=f"m AS (SELECT a.concept_id AS bucket_a, b.concept_id AS bucket_b, round(avg({_COS}), 6) AS mean FROM allvec a JOIN allvec b ON a.concept_id < b.concept_id OR (a.concept_id = b.concept_id AND a.id < b.id) GROUP BY 1, 2)")
def bucket_gap(b: Base) -> DataFrame:
    return vectors.bucket_gap(vectors.bucket_matrix(b.all_vec))


@query(f"""SELECT ca AS concept_id, round(avg(c) FILTER (ca = cb), 6) AS intra, round(avg(c) FILTER (ca <> cb), 6) AS inter FROM (
  SELECT a.concept_id AS ca, b.concept_id AS cb, {_COS} AS c FROM allvec a, allvec b WHERE a.lang = 'en' AND b.lang = 'es') GROUP BY 1""", "allvec")
def cross_gap(b: Base) -> DataFrame:
    return vectors.cross_gap(b.all_vec)


@query("""SELECT concept_id, kind, count(*) AS n, round(avg(1.0::DOUBLE - dist), 6) AS mean FROM (
  SELECT *, CASE WHEN lang_a <> lang_b THEN 'cross-lingual' WHEN a // 2 % 4 = b // 2 % 4 THEN 'same word' ELSE 'other word' END AS kind FROM pairs WHERE a < b) GROUP BY 1, 2""", "pairs")
def word_breakdown(b: Base) -> DataFrame:
    """Similarity within concepts by whether the words are the same; a vector's word is a number made of its id here."""
    word = b.vec.select("id", F.floor(F.col("id") / F.lit(2.0)).alias("w")).select("id", (F.col("w") % 4).cast("string").alias("word"))
    return vectors.word_breakdown(vectors.pairs(b.vec), word)


_W = "(((o * 64 + i * 7) % 13) - 6) / 10.0::DOUBLE"


@query(f"""SELECT concept_id, round(raw_intra - raw_inter, 6) AS raw_gap, round(intra - inter, 6) AS gap, intra - inter > raw_intra - raw_inter AS wins FROM (
  SELECT ca AS concept_id, round(avg(c) FILTER (ca = cb), 6) AS raw_intra, round(avg(c) FILTER (ca <> cb), 6) AS raw_inter, round(avg(p) FILTER (ca = cb), 6) AS intra, round(avg(p) FILTER (ca <> cb), 6) AS inter FROM (
    SELECT a.concept_id AS ca, b.concept_id AS cb, {_COS} AS c, {_COS.replace('.x', '.y')} AS p FROM hv a, hv b WHERE a.id <> b.id) GROUP BY 1)""", "allvec",
       also=f"hv AS (SELECT *, [tanh(list_dot_product(x, [{_W} for i in range(0, 64)])) for o in range(0, 8)] AS y FROM allvec)")
def raw_vs_projected(b: Base) -> DataFrame:
    """By concept: the gap between intra and inter similarity before and after a head, and whether the head widens it."""
    w = F.transform(F.sequence(long(0), long(7)), lambda o: F.transform(F.sequence(long(0), long(63)), lambda i: ((o * 64 + i * 7) % 13 - 6) / F.lit(10.0)))
    projected = b.all_vec.withColumn("x", head(w, F.col("x")))
    return vectors.raw_vs_projected(b.all_vec, projected)


@query("""SELECT concept_id, a, i // 2 AS draw, arg_min(b, (dist, b)) AS pos, arg_max(b, (dist, b)) AS neg, round(max(dist) - min(dist), 6) AS gap FROM (
  SELECT *, row_number() OVER (PARTITION BY concept_id, a ORDER BY sha1(a::VARCHAR || ':' || b::VARCHAR), b) - 1 AS i FROM pairs) WHERE i < 8 GROUP BY 1, 2, 3 HAVING count(*) = 2 AND round(max(dist) - min(dist), 6) >= 0.05""", "pairs")
def pair_draws(b: Base) -> DataFrame:
    return vectors.pair_draws(b.dist, floor=0.05, draws=4)


@query("SELECT concept_id, a, sl_pos, sl_neg, xl_pos, xl_neg FROM five WHERE has_xl QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY sha1('42:' || a::VARCHAR), a) <= 12", "five")
def triplet_audit(b: Base) -> DataFrame:
    return vectors.audit(vectors.five_point_grid(b.grid), 12, "42").select("concept_id", "a", "sl_pos", "sl_neg", "xl_pos", "xl_neg")


@query("""SELECT v.concept_id, count(*) AS anchors, round(avg((f.a IS NULL)::INT), 6) AS rejected, round(avg(f.has_xl::INT), 6) AS with_xl, round(avg(f.margin_sl), 6) AS margin_mean, round(stddev_pop(f.margin_sl), 6) AS margin_std
  FROM allvec v LEFT JOIN five f ON f.concept_id = v.concept_id AND f.a = v.id GROUP BY 1""", "allvec", "five")
def sampler_stats(b: Base) -> DataFrame:
    return vectors.sampler_stats(b.all_vec, vectors.five_point_grid(b.grid))


@query()
def sentence_vectors(b: Base) -> DataFrame:
    """A vector for each stored row, found once for each sentence: its squared length and its first place."""
    v = encode.sentence_vectors(b.points.select("id", "lang", "sentence").distinct(), HashedGrams(32))
    return v.select("id", F.round(dot(F.col("x"), F.col("x")), 4).alias("squared"), F.round(F.get("x", F.lit(0)).cast("double"), 4).alias("first"))


@query()
def concept_vectors(b: Base) -> DataFrame:
    """The pooled vectors of the concepts that documents hold, from vectors of their tokens."""
    v = encode.concept_vectors(b.arts.select(F.col("doc_id").alias("id"), "lang", "text"), b.word_concept, HashedGrams(16))
    return v.select("id", "concept_id", F.round(norm(F.col("x")), 4).alias("length"), F.transform("x", lambda e: F.round(e, 6)).alias("x"))



# Scans that go on ------------------------------------------------------------------------------------------------------------


@query(SQL["cost_projection"])
def cost_projection_resumed(b: Base) -> DataFrame:
    """The projection from a scan that stops after a batch of files and goes on, reading only what isn't counted yet."""
    at = f"{shared_dir(b.spark)}/scan-{uuid.uuid4().hex}"
    for most in (1, None):
        counts = corpus.scanned(b.spark, f"{b.dir}/documents.parquet", at, files_per_batch=8, most_batches=most)
    return corpus.projection(counts, 0.02, 1_000_000)


@query()
def flush_batches(b: Base) -> DataFrame:
    """What buffers of a language and a quarter of its articles write, each flushed at the end of the article that brings it to 512 sentences; files come in two runs."""
    at = f"{shared_dir(b.spark)}/flush-{uuid.uuid4().hex}"
    b.word_concept.write.parquet(f"{at}/words")
    words = b.spark.read.parquet(f"{at}/words")
    cut = b.arts.agg(F.percentile("doc_id", F.lit(0.5))).first()[0] or 0
    for part in (F.col("doc_id") <= cut, F.col("doc_id") > cut):
        b.arts.where(part).select("lang", "doc_id", "text").write.mode("append").parquet(f"{at}/in")
        ingest.flushes(b.spark, f"{at}/in", words, f"{at}/out", f"{at}/checkpoint", files_per_batch=4)
    return ingest.flushed(b.spark, f"{at}/out").groupBy("lang", "shard", "flush").agg(F.count(F.lit(1)).alias("sentences"), F.count_distinct("doc_id").alias("articles"), F.sum(F.size("pairs")).alias("pairs"))
