"""All registered queries by name, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import lexical_index
from ..functions.stem import stems_of
from ..functions.text import ENTRY, TOKEN, WORD, focal_span, token_spans, tokens, valid_entry, words
from ..functions.vector import dot
from ..operators import corpus, encode, graph, sample, search, train, vectors, vocab
from ..sources.store import missing_translations, shared_dir
from ..streaming import ingest
from .base import Base
from .register import QUERIES, SQL, Query, query, tree_sql
from .registry import translated
from .sql import BM25, STOP, STOP_ES, sql

def long(x: int):
    return F.lit(x).cast("long")


# Corpus and text ------------------------------------------------------------------------------------------------------


@query(rf"SELECT lang, count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, max(len(t))::BIGINT AS longest, round(avg(len(list_distinct(t))), 6) AS mean_distinct FROM (SELECT lang, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents) GROUP BY 1")
def token_stats(b: Base) -> DataFrame:
    return corpus.token_stats(b.docs)


@query(rf"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '{WORD}')))::BIGINT AS n_words FROM documents")
def word_stats(b: Base) -> DataFrame:
    return b.docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT lang, doc_id, sent_ord, sentence FROM sents", "sents")
def sentence_split(b: Base) -> DataFrame:
    return b.sents


@query("SELECT lang, doc_id, sent_ord, len(words)::BIGINT AS n_words FROM good", "good")
def sentence_length_filter(b: Base) -> DataFrame:
    return b.good.select("lang", "doc_id", "sent_ord", F.size("words").cast("long").alias("n_words"))


@query("SELECT lang, doc_id, article_ord FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS article_ord FROM art) WHERE article_ord <= 100 AND length(text) >= 50", "art")
def article_budget(b: Base) -> DataFrame:
    return corpus.article_budget(b.arts, 100).select("lang", "doc_id", "article_ord")


@query(rf"SELECT DISTINCT lang, word FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM art) WHERE length(word) >= 2 AND regexp_matches(word, '{ENTRY}')", "art")
def valid_words(b: Base) -> DataFrame:
    return b.arts.select("lang", F.explode(words(F.col("text"))).alias("word")).where(valid_entry(F.col("word"))).distinct()


@query(rf"""SELECT lang, sum(k)::BIGINT AS n_docs, round(sum(n * k)::DOUBLE / sum(k), 6) AS mean_tokens, min(n) FILTER (upto > floor(total * 0.5::DOUBLE)) AS median_tokens,
  min(n) FILTER (upto > floor(total * 0.95::DOUBLE)) AS p95_tokens, round(sum(n * k)::DOUBLE / sum(k) * 1e6::DOUBLE / 1e6::DOUBLE * 0.02::DOUBLE, 6) AS usd FROM (
  SELECT lang, n, k, sum(k) OVER (PARTITION BY lang ORDER BY n) AS upto, sum(k) OVER (PARTITION BY lang) AS total FROM (
    SELECT lang, len(regexp_extract_all(lower(text), '{TOKEN}'))::BIGINT AS n, count(*) AS k FROM documents GROUP BY 1, 2)) GROUP BY 1""")
def cost_projection(b: Base) -> DataFrame:
    return corpus.cost_projection(b.docs, 0.02, 1_000_000)


@query(tree_sql("SELECT lang, doc_id AS key, sha256(doc_id::VARCHAR || chr(31) || text || chr(30)) AS h FROM documents", "lang"))
def corpus_digest(b: Base) -> DataFrame:
    return search.corpus_digest(b.docs)


@query("SELECT sha1(text) AS passage_id, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_ids(b: Base) -> DataFrame:
    return b.docs.groupBy(F.sha1("text").alias("passage_id")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


# Vocabulary -----------------------------------------------------------------------------------------------------------


@query("SELECT dir, ord, src, tgt FROM dict", "dict")
def pseudo_dictionary(b: Base) -> DataFrame:
    return b.dictionary


@query("SELECT dir, src, tgt, rank FROM top", "top")
def topk_translations(b: Base) -> DataFrame:
    return b.top.select("dir", "src", "tgt", "rank")


@query("SELECT u, v, weight FROM edge", "edge")
def edge_weights(b: Base) -> DataFrame:
    return b.edges


@query("SELECT node, component FROM part", "part")
def components(b: Base) -> DataFrame:
    return b.whole


@query("SELECT component, count(*) AS nodes FROM part GROUP BY 1 HAVING count(*) >= 3", "part")
def component_sizes(b: Base) -> DataFrame:
    return b.whole.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).where("nodes >= 3")


@query("SELECT count(*) FILTER (len(en) = 0 OR len(es) = 0) AS monolingual, count(*) FILTER (len(en) > 0 AND len(es) > 0 AND len(en) + len(es) < 3) AS undersized, count(*) FILTER (len(en) > 0 AND len(es) > 0 AND len(en) + len(es) >= 3) AS kept FROM cluster", "cluster")
def cluster_filter(b: Base) -> DataFrame:
    return vocab.filter_report(b.clusters, 3)


@query("SELECT concept_id, array_to_string(en, ' ') AS en, array_to_string(es, ' ') AS es, size FROM concept", "concept")
def concept_numbering(b: Base) -> DataFrame:
    return b.vocab.select("concept_id", F.array_join("en", " ").alias("en"), F.array_join("es", " ").alias("es"), "size")


@query("""SELECT min(size) AS min, max(size) AS max, round(avg(size), 2) AS mean, s[(len(s) // 2) + 1] AS median, s[floor(len(s) * 0.9::DOUBLE)::INT + 1] AS p90, s[floor(len(s) * 0.99::DOUBLE)::INT + 1] AS p99
  FROM (SELECT list_sort(list(size)) AS s FROM concept), concept GROUP BY s""", "concept")
def cluster_size_stats(b: Base) -> DataFrame:
    return vocab.size_stats(b.vocab)


@query("""SELECT round(sum(i) / m - sum(k::DOUBLE * k) / (4.0::DOUBLE * m * m), 6) AS modularity FROM (SELECT part, sum(k) AS k, sum(i) AS i FROM (
    SELECT a.component AS part, weight AS k, CASE WHEN a.component = c.component THEN weight ELSE 0 END AS i FROM edge JOIN part a ON a.node = u JOIN part c ON c.node = v
    UNION ALL SELECT c.component, weight, 0 FROM edge JOIN part c ON c.node = v) GROUP BY 1), (SELECT sum(weight)::DOUBLE AS m FROM edge) GROUP BY m""", "edge", "part")
def modularity(b: Base) -> DataFrame:
    return graph.modularity(b.edges, b.parts)


@query("""SELECT component, count(*) FILTER (node LIKE 'en:%') AS n_en, count(*) FILTER (node LIKE 'es:%') AS n_es, any_value(coalesce(k, 0)) AS inner_edges,
  round(any_value(coalesce(k, 0)) / (count(*) FILTER (node LIKE 'en:%') * count(*) FILTER (node LIKE 'es:%'))::DOUBLE, 6) AS density
  FROM part LEFT JOIN (SELECT a.component AS c, count(*) AS k FROM edge JOIN part a ON a.node = u JOIN part z ON z.node = v WHERE a.component = z.component GROUP BY 1) ON c = component
  GROUP BY 1 HAVING count(*) FILTER (node LIKE 'en:%') > 0 AND count(*) FILTER (node LIKE 'es:%') > 0""", "edge", "part")
def translation_density(b: Base) -> DataFrame:
    return graph.density(b.edges, b.parts)


@query("""SELECT weight, count(*) AS edges, round(avg((a.component IS NOT DISTINCT FROM z.component AND a.component IS NOT NULL)::INT), 6) AS recall
  FROM edge LEFT JOIN (FROM part WHERE node NOT LIKE '%a') a ON a.node = u LEFT JOIN (FROM part WHERE node NOT LIKE '%a') z ON z.node = v GROUP BY 1""", "edge", "part")
def edge_recall(b: Base) -> DataFrame:
    return graph.edge_recall(b.edges, b.parts.where(~F.col("node").endswith("a")))


@query("""SELECT count(*) AS evaluated, round(avg((a.component = z.component)::INT), 6) AS recall FROM edge JOIN tpart a ON a.node = u JOIN tpart z ON z.node = v
  WHERE ('0x' || substr(sha1(u || '|' || v), 1, 8))::BIGINT % 10 < 1""", "edge", "tpart")
def heldout_recall(b: Base) -> DataFrame:
    """A tenth of the edges against communities that are made without them."""
    e = graph.cut(graph.held_out(b.edges))
    rest = e.where("not held").drop("held")
    parts = graph.louvain_parts(rest, graph.components(rest)).select("node", F.col("part").alias("component"))
    return graph.recall_of(e.where("held"), parts)


@query("SELECT lang, word, concept_id FROM wc", "wc")
def word_lookup(b: Base) -> DataFrame:
    return b.word_concept


@query("SELECT lang, concept_id, n FROM counts", "counts")
def concept_scan(b: Base) -> DataFrame:
    return b.counts


@query("SELECT count(*) AS concepts, count(*) FILTER (en_n > 0 AND es_n > 0) AS both, count(*) FILTER (en_n > 0 AND es_n = 0) AS only_en, count(*) FILTER (es_n > 0 AND en_n = 0) AS only_es FROM supply", "supply")
def both_lang_coverage(b: Base) -> DataFrame:
    s = vocab.supply(b.vocab, b.counts)
    en, es = F.col("en_n") > 0, F.col("es_n") > 0
    return s.agg(F.count(F.lit(1)).alias("concepts"), F.count_if(en & es).alias("both"), F.count_if(en & ~es).alias("only_en"), F.count_if(es & ~en).alias("only_es"))


@query("SELECT printf('C-%05d', row_number() OVER (ORDER BY size DESC, concept_id) - 1) AS concept_id, concept_id AS old_id, size FROM supply WHERE least(en_n, es_n) >= 50", "supply")
def prune(b: Base) -> DataFrame:
    return vocab.prune(b.vocab, b.counts, 50).select("concept_id", "old_id", "size")


@query("SELECT concept_id, size FROM concept WHERE concept_id IN ('C-00000', 'C-00007', 'C-00042')", "concept")
def vocab_subset(b: Base) -> DataFrame:
    return vocab.subset(b.vocab, b.values([("C-00000",), ("C-00007",), ("C-00042",)], "concept_id string")).select("concept_id", "size")


@query("SELECT count(*) AS concepts, count(*) FILTER (m >= 1000) AS over_1000, count(*) FILTER (m >= 500) AS over_500, count(*) FILTER (m >= 100) AS over_100, median(m)::DOUBLE AS median FROM (SELECT least(en_n, es_n) AS m FROM supply)", "supply")
def supply(b: Base) -> DataFrame:
    m = vocab.supply(b.vocab, b.counts).select(F.least("en_n", "es_n").alias("m"))
    return m.agg(F.count(F.lit(1)).alias("concepts"), *[F.count_if(F.col("m") >= k).alias(f"over_{k}") for k in (1000, 500, 100)], F.percentile("m", F.lit(0.5)).alias("median"))


_POOL = "CASE WHEN list_sum([('0x' || c)::INT for c in string_split(sha1(item_id::VARCHAR), '')]) % 5 <> 0 THEN 'select' ELSE 'holdout' END"
_DEMAND = f"""dm AS (SELECT w.concept_id, q.pool FROM (SELECT {_POOL} AS pool, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM benchmark) q JOIN wc w ON w.word = q.word),
  need AS (SELECT concept_id, count(*) AS demand FROM dm WHERE pool = 'select' GROUP BY 1)"""


def _matched(b: Base) -> DataFrame:
    q = b.table("benchmark").select(vocab.pool(F.col("item_id")).alias("pool"), F.explode(tokens(F.col("text"))).alias("word"))
    return q.join(b.word_concept, "word")


@query()
def demand(b: Base) -> DataFrame:
    return vocab.demand(_matched(b))


SQL["demand"] = sql("", "wc").rstrip() + ", " + _DEMAND + " SELECT concept_id, demand FROM need"


@query()
def demand_marks(b: Base) -> DataFrame:
    return vocab.demand_marks(vocab.demand(_matched(b)))


SQL["demand_marks"] = sql("", "wc").rstrip() + ", " + _DEMAND + """, run AS (
  SELECT sum(demand) OVER o AS cum, count(*) OVER o AS n, sum(demand) OVER () AS total FROM need WINDOW o AS (ORDER BY demand DESC, concept_id ROWS UNBOUNDED PRECEDING))
  SELECT mark, min(n) AS concepts FROM run, (SELECT unnest([0.8, 0.9, 0.95, 0.99])::DOUBLE AS mark) WHERE cum >= mark * total GROUP BY 1"""


@query(f"SELECT {_POOL} AS pool, count(*) AS n FROM benchmark GROUP BY 1")
def demand_pools(b: Base) -> DataFrame:
    return b.table("benchmark").groupBy(vocab.pool(F.col("item_id")).alias("pool")).agg(F.count(F.lit(1)).alias("n"))


# Sampling -------------------------------------------------------------------------------------------------------------


@query("SELECT lang, concept_id, doc_id, sent_ord, word, rank FROM capped", "capped")
def capped_rows(b: Base) -> DataFrame:
    return sample.capped_places(sample.word_places(b.arts), b.word_concept).select("lang", "concept_id", "doc_id", "sent_ord", "word", "rank")


@query("SELECT id, concept_id, rank FROM points", "points")
def point_ids(b: Base) -> DataFrame:
    return b.points.select("id", "concept_id", "rank")


@query("SELECT id, lang, concept_id, word, doc_id, sent_ord FROM latest", "latest")
def upsert_latest(b: Base) -> DataFrame:
    return b.latest


@query("SELECT id, lang, concept_id FROM balanced", "balanced")
def balance(b: Base) -> DataFrame:
    return b.balanced


@query("SELECT id, lang, concept_id, pos FROM ordered", "ordered")
def interleave(b: Base) -> DataFrame:
    return b.ordered


@query("""SELECT id, concept_id, pos, CASE WHEN pos > n - (CASE WHEN n > 3 THEN least(greatest(floor(n * 0.2::DOUBLE), 1), n - 3) ELSE 0 END) THEN 'validation' ELSE 'train' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY concept_id) AS n FROM ordered)""", "ordered")
def tail_split(b: Base) -> DataFrame:
    return sample.tail_split(b.ordered).select("id", "concept_id", "pos", "part")


@query(r"""SELECT id, array_to_string(p[greatest(k - 5, 1):k + 5], ' ') AS trimmed FROM (SELECT *, list_position(list_transform(p, lambda w: lower(regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g'))), word) AS k
    FROM (SELECT DISTINCT id, word, sentence, regexp_split_to_array(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '\s+') AS p FROM points)) WHERE k IS NOT NULL AND k > 0 AND array_to_string(p[greatest(k - 5, 1):k + 5], ' ') <> sentence""", "points")
def trim(b: Base) -> DataFrame:
    return sample.trims(b.points.select("id", "word", "sentence").distinct()).select("id", "trimmed")


@query("SELECT concept_id, lang, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT p.concept_id, p.lang, p.id FROM points p JOIN (SELECT concept_id FROM concept WHERE size >= 3) USING (concept_id)) GROUP BY 1, 2", "points")
def rematch_buckets(b: Base) -> DataFrame:
    chosen = b.vocab.where("size >= 3").select("concept_id")
    return b.points.join(chosen, "concept_id", "left_semi").select("concept_id", "lang", "id").distinct().groupBy("concept_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("SELECT lang, count(*) AS n, count(DISTINCT id) AS n_distinct, round(1.0::DOUBLE - count(DISTINCT id) / count(*)::DOUBLE, 6) AS repeated FROM points GROUP BY 1", "points")
def dedup_ratio(b: Base) -> DataFrame:
    return b.points.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"), F.round(F.lit(1.0) - F.count_distinct("id") / F.count(F.lit(1)).cast("double"), 6).alias("repeated"))


# Encoding -------------------------------------------------------------------------------------------------------------

_MATCH = f"rows AS (SELECT doc_id AS id, lang, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM art)"


def _rows(b: Base) -> DataFrame:
    return b.arts.select(F.col("doc_id").alias("id"), "lang", F.explode(tokens(F.col("text"))).alias("token"))


@query()
def concept_match(b: Base) -> DataFrame:
    return encode.matches(_rows(b), b.word_concept).groupBy("id", "concept_id").agg(F.count(F.lit(1)).alias("n"))


SQL["concept_match"] = sql("", "wc").rstrip() + ", " + _MATCH + " SELECT id, concept_id, count(*) AS n FROM rows JOIN wc ON wc.lang = rows.lang AND wc.word = rows.token GROUP BY 1, 2"


@query()
def lemma_match(b: Base) -> DataFrame:
    rows = graph.cut(_rows(b).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")))  # a token's concept is the same in all texts
    lemma = F.when(F.col("token").endswith("s") & (F.length("token") > 3), F.expr("substring(token, 1, length(token) - 1)"))
    lemmas = rows.select("lang", F.col("token").alias("form"), lemma.alias("lemma")).where("lemma is not null").distinct()
    return encode.matches(rows, b.word_concept, lemmas).groupBy("lang", "concept_id").agg(F.sum("n").alias("n"))


SQL["lemma_match"] = sql("", "wc").rstrip() + ", " + _MATCH + """ SELECT rows.lang, coalesce(a.concept_id, l.concept_id) AS concept_id, count(*) AS n FROM rows LEFT JOIN wc a ON a.lang = rows.lang AND a.word = rows.token
  LEFT JOIN wc l ON l.lang = rows.lang AND length(rows.token) > 3 AND rows.token LIKE '%s' AND l.word = substr(rows.token, 1, length(rows.token) - 1)
  WHERE coalesce(a.concept_id, l.concept_id) IS NOT NULL GROUP BY 1, 2"""


@query("SELECT id, term, d AS weight FROM dpost", "dpost")
def backbone_doc(b: Base) -> DataFrame:
    return encode.backbone_doc(b.doc_tokens)


@query(f"SELECT DISTINCT qid AS id, term, 1.0::DOUBLE AS weight FROM qstem WHERE token NOT IN ({STOP_ES})", "qstem")
def backbone_query(b: Base) -> DataFrame:
    kept = b.query_tokens.where(~F.col("token").isin(*encode.STOPWORDS["es"]))
    return encode.backbone_query(kept)


@query("""SELECT t.id, 8 * substr(m.concept_id, 3)::BIGINT AS idx, round(count(*)::DOUBLE * 2.2::DOUBLE / (count(*)::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * any_value(t.length) / 256.0::DOUBLE)), 6) AS weight
  FROM dterm t JOIN wc m ON m.lang = t.lang AND m.word = t.token GROUP BY 1, m.concept_id""", "dterm", "wc")
def lexical_encode(b: Base) -> DataFrame:
    rows = b.doc_tokens.join(b.docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    return encode.lexical_blocks(encode.matches(rows, b.word_concept), rows.select("id", "length").distinct())


@query(f"SELECT id, term, {BM25} * CASE WHEN lang = 'es' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ltf", "ltf")
def xl_weight(b: Base) -> DataFrame:
    own = encode.backbone_or_concept(b.lang_tokens, b.word_concept).where("concept_id IS NULL")
    weight = F.round(encode.bm25(F.col("tf").cast("double"), F.col("length")), 6)
    return own.select("id", "term", (weight * F.when(F.col("lang") == "es", 0.5).otherwise(1.0)).alias("weight"))


@query("SELECT term, count(*) AS df FROM dpost GROUP BY 1", "dpost")
def doc_freq(b: Base) -> DataFrame:
    return search.doc_freq(encode.backbone_doc(b.doc_tokens))


@query("SELECT id, array_to_string(list(term ORDER BY term), ' ') AS terms, array_to_string(list(round(d::FLOAT::DOUBLE * 10000)::BIGINT ORDER BY term), ' ') AS weights FROM dpost GROUP BY 1", "dpost")
def packed_vectors(b: Base) -> DataFrame:
    p = encode.packed(encode.backbone_doc(b.doc_tokens).withColumnRenamed("term", "idx"))
    return p.select("id", F.array_join("indices", " ").alias("terms"), F.array_join(F.transform("values", lambda v: F.round(v.cast("double") * 10000).cast("long").cast("string")), " ").alias("weights"))


@query("SELECT DISTINCT term, idx FROM dterm JOIN idx USING (term)", "dterm", "idx")
def murmur_index(b: Base) -> DataFrame:
    return b.doc_tokens.select("term").distinct().withColumn("idx", lexical_index("term"))


@query("SELECT DISTINCT token, term AS stem FROM dterm", "dterm")
def stem(b: Base) -> DataFrame:
    return b.doc_tokens.select("token", F.col("term").alias("stem")).distinct()


_ENCODED = """SELECT id, idx, arg_max({w}, term) AS value FROM {v} JOIN idx USING (term) GROUP BY 1, 2 UNION ALL SELECT id, 8 * substr(concept_id, 3)::BIGINT, {c} FROM {n}"""


@query(_ENCODED.format(w=BM25, v="ltf", c=BM25, n="lctf"), "ltf", "lctf", "idx")
def encode_sparse(b: Base) -> DataFrame:
    """Each document's whole vector in lexical mode: hashed stems, and concepts in the place of their words."""
    return encode.encode_sparse(b.lang_tokens, b.word_concept, False)


@query("""SELECT qid AS id, idx, 0.5::DOUBLE AS value FROM (SELECT DISTINCT qid, idx FROM lexq JOIN idx ON idx.term = substr(lexq.term, 3) WHERE ql = 'en' AND lexq.term LIKE 't:%')
  UNION ALL SELECT qid, 8 * substr(term, 5)::BIGINT, 1.0::DOUBLE FROM lexq WHERE ql = 'en' AND term LIKE 'c:%'""", "lexq", "idx")
def encode_query(b: Base) -> DataFrame:
    """Queries of another language than the documents': the backbone weighs half."""
    return encode.encode_sparse(b.query_tokens.withColumn("lang", F.lit("en")), b.word_concept, True, 0.5)


# Search and evaluation ------------------------------------------------------------------------------------------------


@query("SELECT qid, id, score, rank FROM run", "run")
def bm25_top10(b: Base) -> DataFrame:
    return b.ranked_docs()


@query("SELECT qid, ndcg10, r100, mrr10 FROM metric", "metric")
def bm25_metrics(b: Base) -> DataFrame:
    return b.per_query


@query("""SELECT count(*) AS n_queries, round(avg(ndcg10), 6) AS ndcg10_mean, round(stddev_pop(ndcg10), 6) AS ndcg10_std, round(avg(r100), 6) AS r100_mean, round(stddev_pop(r100), 6) AS r100_std,
  round(avg(mrr10), 6) AS mrr10_mean, round(stddev_pop(mrr10), 6) AS mrr10_std FROM metric""", "metric")
def bm25_eval(b: Base) -> DataFrame:
    return search.summary(b.per_query)


_RANK = """ SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT q.qid, p.id, round(sum(ln(1.0::DOUBLE + ((SELECT count(*) FROM documents WHERE lang = 'es') - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * q.q * p.d), 6) AS score
    FROM {q} q JOIN {p} p ON q.term = p.term JOIN (SELECT term, count(*) AS df FROM {p} GROUP BY 1) f ON f.term = p.term GROUP BY 1, 2) QUALIFY rank <= 5"""


@query(_RANK.format(q="lq", p="lexes"), "lex", "lexq", also="lexes AS (FROM lex WHERE lang = 'es'), lq AS (FROM lexq WHERE ql = 'en')")
def lexical_search(b: Base) -> DataFrame:
    es = b.docs.where("lang = 'es'")
    d = encode.lexical_vectors(encode.token_rows(es.select(F.col("doc_id").alias("id"), "text")).withColumn("lang", F.lit("es")), b.word_concept, False)
    q = encode.lexical_vectors(b.query_tokens.withColumn("lang", F.lit("en")), b.word_concept, True)
    return search.search(q.select(F.col("id").alias("qid"), "term", F.col("weight").alias("q")), d.withColumnRenamed("weight", "d"), es.count(), 5)


@query(_RANK.format(q="tr", p="esp"), "dpost", "qword", "trans", "trstem", also="esp AS (FROM dpost WHERE lang = 'es'), tr AS (SELECT DISTINCT qid, stem AS term, 1.0::DOUBLE AS q FROM qword LEFT JOIN trans ON src = token JOIN trstem s ON s.token = coalesce(tgt, qword.token))")
def translate_bm25(b: Base) -> DataFrame:
    es = b.docs.where("lang = 'es'")
    q = translated(b.query_tokens.select(F.col("id").alias("qid"), F.lit(0).alias("ord"), "token"), b.translations)
    q = q.select("qid", F.get(stems_of(F.array("token")), F.lit(0)).alias("term")).distinct().withColumn("q", F.lit(1.0))
    rows = encode.token_rows(es.select(F.col("doc_id").alias("id"), "text"))
    return search.search(q, encode.backbone_doc(rows).withColumnRenamed("weight", "d"), es.count(), 5)


_QC = "qc AS (SELECT DISTINCT q.qid, m.concept_id FROM qword q JOIN wc m ON m.lang = 'en' AND m.word = q.token)"


def coverage_of(b: Base) -> DataFrame:
    q = encode.matches(b.query_tokens.withColumn("lang", F.lit("en")), b.word_concept).select(F.col("id").alias("qid"), "concept_id").distinct()
    d = encode.matches(_rows(b), b.word_concept).select("id", "concept_id").distinct()
    return search.covered(q, b.gold, d)


@query()
def coverage(b: Base) -> DataFrame:
    return coverage_of(b)


SQL["coverage"] = sql("", "qword", "wc", "gold", "art").rstrip() + ", " + _QC + ", " + _MATCH + ", dc AS (SELECT DISTINCT id, concept_id FROM rows JOIN wc ON wc.lang = rows.lang AND wc.word = rows.token) SELECT DISTINCT qc.qid FROM qc JOIN gold USING (qid) JOIN dc ON dc.id = gold.id AND dc.concept_id = qc.concept_id"


@query("SELECT d.doc_id AS id, CASE WHEN g.id IS NULL THEN 'distractor' ELSE 'gold' END AS kind FROM documents d LEFT JOIN (SELECT DISTINCT id FROM gold) g ON g.id = d.doc_id QUALIFY g.id IS NOT NULL OR row_number() OVER (PARTITION BY g.id IS NULL ORDER BY d.doc_id) <= 200", "gold")
def distractor_corpus(b: Base) -> DataFrame:
    return search.distractors(b.docs.select(F.col("doc_id").alias("id")), b.gold.select("id").distinct(), 200)


@query(tree_sql("SELECT qid AS key, sha256(qid::VARCHAR || chr(31) || string_agg(id::VARCHAR, '|' ORDER BY rank) || chr(30)) AS h FROM run GROUP BY qid"), "run")
def rank_digest(b: Base) -> DataFrame:
    return search.rank_digest(b.ranked_docs())


_REPORT = "SELECT lang AS pair, 'mean_chars' AS metric, round(avg(length(text)), 6) AS value FROM documents GROUP BY 1"
_BARS = [("en", "mean_chars", "old", 2000.0), ("es", "mean_chars", "old", 4000.0), ("en", "mean_chars", "other", 100.0), ("fr", "mean_chars", "old", 1e9)]
_BARS_SQL = "(VALUES " + ", ".join(f"('{p}', '{m}', '{n}', {v!r}::DOUBLE)" for p, m, n, v in _BARS) + ") t(pair, metric, name, bar)"


def _report(b: Base) -> tuple[DataFrame, DataFrame]:
    r = b.docs.groupBy(F.col("lang").alias("pair")).agg(F.round(F.avg(F.length("text")), 6).alias("value")).withColumn("metric", F.lit("mean_chars"))
    return r, b.values(_BARS, "pair string, metric string, name string, value double")


@query(f"SELECT w.pair, w.metric, w.name, r.value, t.bar, coalesce(r.value > t.bar, true) AS passed FROM (VALUES ('en', 'mean_chars', 'old'), ('es', 'mean_chars', 'old'), ('de', 'mean_chars', 'old'), ('fr', 'mean_chars', 'old')) w(pair, metric, name) LEFT JOIN ({_REPORT}) r USING (pair, metric) LEFT JOIN {_BARS_SQL} USING (pair, metric, name)")
def gate_check(b: Base) -> DataFrame:
    r, bars = _report(b)
    return search.gate(r, b.values([(p, "mean_chars", "old") for p in ("en", "es", "de", "fr")], "pair string, metric string, name string"), bars)


@query(f"SELECT r.pair, r.metric, t.name, round(r.value - t.bar, 6) AS delta FROM ({_REPORT}) r JOIN {_BARS_SQL} USING (pair, metric)")
def report_delta(b: Base) -> DataFrame:
    return search.deltas(*_report(b))


@query("""SELECT pair, qid, CASE WHEN n <= 10 THEN 'dev' WHEN n <= 20 THEN 'validation' ELSE 'test' END AS split, CASE WHEN n <= 10 THEN n WHEN n <= 20 THEN n - 10 ELSE n - 20 END AS ord FROM (
  SELECT pair, item_id AS qid, row_number() OVER (PARTITION BY pair ORDER BY sha256('42::' || pair || '::' || item_id::VARCHAR), item_id) AS n FROM benchmark, (VALUES ('eng-eng'), ('eng-spa')) p(pair))""")
def hash_split(b: Base) -> DataFrame:
    q = b.table("benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(F.lit("eng-eng"), F.lit("eng-spa"))).alias("pair"))
    return search.hash_split(q, 10, 10, "42")


_SHIFTED = """shifted AS (SELECT r.qid, sum(1.0::DOUBLE / log2(rank::DOUBLE)) FILTER (rank <= 11) AS dcg FROM run100 r JOIN gold g ON g.qid = r.qid AND g.id = r.id WHERE rank > 1 GROUP BY 1),
  ab AS (SELECT m.qid, m.ndcg10 AS a, round(coalesce(s.dcg / i.ideal, 0), 6) AS b FROM metric m LEFT JOIN shifted s USING (qid) LEFT JOIN ideal i USING (qid)),
  drawn AS (SELECT draw, a, b, """ + " + ".join(f"(u > {x!r}::DOUBLE)::INT" for x in search.POISSON) + """ AS w FROM (
    SELECT *, (('0x' || substr(sha1(qid::VARCHAR || ':' || draw::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM ab, (SELECT unnest(range(1, 201)) AS draw))),
  means AS (SELECT draw, round(sum(w * (a - b)) / greatest(sum(w), 1), 9) AS d FROM drawn GROUP BY 1)"""


@query("""SELECT (SELECT round(avg(a - b), 6) FROM ab) AS delta, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high,
  round(least(1.0::DOUBLE, 2.0::DOUBLE * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) AS p FROM means""", "run100", "gold", "metric", also=_SHIFTED)
def significance(b: Base) -> DataFrame:
    """The ranking against itself without its first place, by bootstrap."""
    a = b.per_query.select("qid", F.col("ndcg10").alias("a"))
    worse = b.first_hundred.where("rank > 1").withColumn("rank", F.col("rank") - 1)
    z = search.metrics(worse, b.gold, b.items).select("qid", F.col("ndcg10").alias("b"))
    return search.bootstrap(a.join(z, "qid"), 200)


# Vectors --------------------------------------------------------------------------------------------------------------


@query("SELECT concept_id, a, b, dist FROM pairs WHERE a < b", "pairs")
def distance_matrix(b: Base) -> DataFrame:
    return vectors.pairs(b.vec).select("concept_id", "a", "b", "dist")


@query("SELECT concept_id, count(*) AS n_pairs, round(CASE WHEN count(*) >= 3 THEN greatest(0.1::DOUBLE, 2.0::DOUBLE * stddev_pop(dist)) ELSE 0.1::DOUBLE END, 6) AS margin FROM pairs WHERE a < b GROUP BY 1", "pairs")
def dynamic_margin(b: Base) -> DataFrame:
    return vectors.dynamic_margin(vectors.pairs(b.vec), 0.1, 2.0)


@query("SELECT concept_id, a, lang_a, lang_b, pos_rank, pos, neg, gap FROM grid", "grid")
def mining_grid(b: Base) -> DataFrame:
    return b.grid


@query("FROM five", "five")
def five_point_grid(b: Base) -> DataFrame:
    return vectors.five_point_grid(b.grid)


_D = "1.0::DOUBLE - list_dot_product(a.x, {r}.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product({r}.x, {r}.x)) + 1e-8::DOUBLE)"


@query(f"""SELECT count(*) AS n, round(avg(greatest(0.0::DOUBLE, ({_D.format(r='p')}) - ({_D.format(r='n')}) + margin_sl) + has_xl::INT * greatest(0.0::DOUBLE, ({_D.format(r='xp')}) - ({_D.format(r='xn')}) + margin_xl)), 6) AS loss
  FROM five JOIN allvec a ON a.id = five.a JOIN allvec p ON p.id = sl_pos JOIN allvec n ON n.id = sl_neg JOIN allvec xp ON xp.id = xl_pos JOIN allvec xn ON xn.id = xl_neg""", "five", "allvec")
def triplet_loss(b: Base) -> DataFrame:
    return vectors.triplet_loss(vectors.five_point_grid(b.grid), b.all_vec)


@query("SELECT margin, count(*) AS n, round(avg((round(margin - gap, 6) >= 0)::INT), 6) AS rejected FROM grid, (SELECT unnest([0.0, 0.05, 0.1, 0.2])::DOUBLE AS margin) GROUP BY 1", "grid")
def rejection_rate(b: Base) -> DataFrame:
    return vectors.rejection(b.grid, (0.0, 0.05, 0.1, 0.2))


@query("""SELECT a.concept_id, count(DISTINCT a.id) AS n, round(avg(c) FILTER (a.concept_id = b.concept_id), 6) AS intra, round(avg(c) FILTER (a.concept_id <> b.concept_id), 6) AS inter
  FROM (SELECT a.concept_id AS ca, b.concept_id AS cb, a, b, list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) AS c FROM allvec a, allvec b WHERE a.id <> b.id) GROUP BY 1""", "allvec")
def intra_inter(b: Base) -> DataFrame:
    return vectors.intra_inter(b.all_vec)


@query("""SELECT count(*) AS n, round(avg((ca = cb)::INT), 6) AS same_concept FROM (SELECT a.id, a.concept_id AS ca, b.concept_id AS cb FROM allvec a, allvec b WHERE a.lang = 'en' AND a.id % 50 = 0 AND b.lang = 'es'
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 6) DESC, b.id) = 1)""", "allvec")
def xl_top1(b: Base) -> DataFrame:
    return vectors.cross_top1(b.all_vec, F.col("id") % 50 == 0)


@query("""SELECT concept_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90
  FROM (SELECT concept_id, sqrt(list_dot_product(x, x)) AS v FROM allvec) GROUP BY 1""", "allvec")
def norm_stats(b: Base) -> DataFrame:
    return vectors.norm_stats(b.all_vec)


@query("""SELECT concept_id, count(*) AS n, round(avg(CASE WHEN own IS NULL OR other IS NULL THEN 0.0::DOUBLE ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM (
  SELECT concept_id, a, min(d) FILTER (ca = cb) AS own, min(d) FILTER (ca <> cb) AS other FROM (
    SELECT a.concept_id, a.id AS a, a.id % 3 AS ca, b.id % 3 AS cb, avg(list_distance(a.x, b.x)) AS d FROM vec a JOIN vec b ON a.concept_id = b.concept_id AND a.id <> b.id GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1""", "vec")
def silhouette(b: Base) -> DataFrame:
    return vectors.silhouette(b.vec.withColumn("cluster", F.col("id") % 3))


@query("""SELECT id, 8 * c + i - 1 AS idx, round(y[i] / greatest(sqrt(list_dot_product(y, y)), 1e-6::DOUBLE), 6) AS value FROM (
  SELECT id, substr(concept_id, 3)::BIGINT AS c, [tanh(list_dot_product(x, [(((o * 64 + i * 7 + substr(concept_id, 3)::BIGINT) % 13) - 6) / 10.0::DOUBLE for i in range(0, 64)])) for o in range(0, 8)] AS y FROM allvec), range(1, 9) t(i)
  WHERE abs(y[i] / greatest(sqrt(list_dot_product(y, y)), 1e-6::DOUBLE)) > 1e-6""", "allvec")
def head_project(b: Base) -> DataFrame:
    label = F.substring("concept_id", 3, 20).cast("long")
    w = F.transform(F.sequence(long(0), long(7)), lambda o: F.transform(F.sequence(long(0), long(63)), lambda i: ((o * 64 + i * 7 + label) % 13 - 6) / F.lit(10.0)))
    heads = b.all_vec.select("concept_id").distinct().withColumn("weights", w)
    return encode.learned_blocks(b.all_vec.withColumn("weight", F.lit(1.0)), heads)


_UNIT = "[e / greatest(sqrt(list_dot_product(x, x)), 1e-12::DOUBLE) for e in x]"


@query(f"""SELECT id, k - 1 AS i, round(({_UNIT})[k], 6) AS value FROM range(1, 65) u(k), (SELECT id, list(v ORDER BY i) AS x FROM (SELECT id, i, avg(x[i]) AS v FROM (
    SELECT id, occ, {_UNIT} AS x FROM (SELECT id, occ, list(v ORDER BY i) AS x FROM (
      SELECT vec_id // 8 AS id, occ, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, (VALUES (0, 0, 12), (1, 18, 27)) s(occ, b, e), range(1, 65) t(i)
      WHERE (vec_id % 8) * 5 < e AND (vec_id % 8) * 5 + 4 > b GROUP BY ALL) GROUP BY 1, 2)), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)""")
def pool_spans(b: Base) -> DataFrame:
    at = F.col("vec_id") % 8 * 5
    rows = b.table("embeddings").select(F.floor(F.col("vec_id") / F.lit(8.0)).alias("id"), at.alias("s"), (at + 4).alias("e"), F.col("embedding").cast("array<double>").alias("x"))
    spans = rows.select("id").distinct().select("id", F.inline(F.array(F.struct(F.lit(0).alias("occ"), F.lit(0).alias("start"), F.lit(12).alias("end")), F.struct(F.lit(1).alias("occ"), F.lit(18).alias("start"), F.lit(27).alias("end")))))
    return vectors.pooled(rows, spans).select("id", F.posexplode("x").alias("i", "v")).select("id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("value"))


_SENSES = (("money", r"(^|\W)the\W"), ("river", r"(^|\W)thand\W"), ("other", r"(^|\W)erthly\W"))


_SENSE_SQL = ("SELECT lang, CASE WHEN a + b + c = 1 THEN CASE WHEN a = 1 THEN 'money' WHEN b = 1 THEN 'river' ELSE 'other' END ELSE 'other_' || lang END AS bucket, sentence FROM (SELECT lang, sentence, "
              + ", ".join(f"regexp_matches(sentence, '{r}')::INT AS {x}" for (_, r), x in zip(_SENSES, "abc", strict=True)) + " FROM sents)")


def sense_of() -> Column:
    """The sense whose pattern alone a sentence meets, else other in its language."""
    hits = [F.col("sentence").rlike(r) for _, r in _SENSES]
    one = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) == 1
    name = F.when(hits[0], _SENSES[0][0]).when(hits[1], _SENSES[1][0]).otherwise(_SENSES[2][0])
    return F.when(one, name).otherwise(F.concat(F.lit("other_"), "lang"))


@query(f"SELECT lang, bucket, count(*) AS n FROM ({_SENSE_SQL}) GROUP BY 1, 2", "sents")
def sense_buckets(b: Base) -> DataFrame:
    return b.sents.groupBy("lang", sense_of().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Further views ----------------------------------------------------------------------------------------------------------


@query("SELECT concept_id, count(*) AS n FROM latest GROUP BY 1", "latest")
def facet_counts(b: Base) -> DataFrame:
    return b.latest.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, concept_id, lang FROM latest QUALIFY row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) <= 8", "latest")
def concept_scroll(b: Base) -> DataFrame:
    return sample.scroll(b.latest, 8).select("id", "concept_id", "lang")


@query("SELECT concept_id, size FROM concept WHERE substr(concept_id, 3)::INT >= 10 AND substr(concept_id, 3)::INT < 40 AND concept_id NOT IN ('C-00012', 'C-00020')", "concept")
def concept_selection(b: Base) -> DataFrame:
    done = b.values([("C-00012",), ("C-00020",)], "concept_id string")
    return vocab.chosen(b.vocab, "10:40", done).select("concept_id", "size")


@query("SELECT concept_id, least(en_n, es_n) AS supplied FROM supply WHERE least(en_n, es_n) >= 5 ORDER BY supplied DESC, concept_id LIMIT 25", "supply")
def best_supplied(b: Base) -> DataFrame:
    return vocab.best_supplied(vocab.supply(b.vocab, b.counts), 5, 25)


@query(f"SELECT concept_id FROM concept WHERE len(list_filter(list_concat(en, es), lambda w: length(w) >= 4 AND w NOT IN ({STOP}, {STOP_ES}))) > 0", "concept")
def content_concepts(b: Base) -> DataFrame:
    return vocab.content_concepts(b.vocab, encode.STOPWORDS["en"] + encode.STOPWORDS["es"]).select("concept_id")


_PLACED = f"""placed AS (FROM part WHERE node NOT LIKE '%a'),
  one AS (SELECT dir, src, arg_min(tgt, ord) AS tgt FROM dict WHERE src <> tgt AND length(src) >= 2 AND length(tgt) >= 2 AND regexp_matches(src, '{ENTRY}') AND regexp_matches(tgt, '{ENTRY}') GROUP BY 1, 2),
  a0 AS (SELECT 'en:' || src AS node, 'es:' || tgt AS dest FROM one WHERE dir = 'en-es' AND 'en:' || src NOT IN (SELECT node FROM placed)),
  a AS (SELECT a0.node, coalesce(p.component, dest) AS component FROM a0 LEFT JOIN placed p ON p.node = dest UNION SELECT dest, dest FROM a0 WHERE dest NOT IN (SELECT node FROM placed)),
  placed2 AS (SELECT node, component FROM placed UNION ALL FROM a),
  z0 AS (SELECT 'es:' || src AS node, 'en:' || tgt AS dest FROM one WHERE dir = 'es-en' AND 'es:' || src NOT IN (SELECT node FROM placed2)),
  z AS (SELECT z0.node, coalesce(p.component, dest) AS component FROM z0 LEFT JOIN placed2 p ON p.node = dest UNION SELECT dest, dest FROM z0 WHERE dest NOT IN (SELECT node FROM placed2))"""


@query()
def attach_orphans(b: Base) -> DataFrame:
    return vocab.attach_orphans(b.dictionary, b.parts.where(~F.col("node").endswith("a")))


SQL["attach_orphans"] = sql("", "part", "dict").rstrip() + ", " + _PLACED + " SELECT node, component FROM a UNION ALL SELECT node, component FROM z"


@query("SELECT id, concept_id, CASE WHEN k > 0 THEN k - 1 END AS start, CASE WHEN k > 0 THEN k - 1 + length(word) END AS stop FROM (SELECT *, strpos(lower('passage: ' || sentence), word) AS k FROM points)", "points")
def focal_offsets(b: Base) -> DataFrame:
    s = b.points.withColumn("span", focal_span(F.col("sentence"), F.col("word")))
    return s.select("id", "concept_id", F.col("span.start").alias("start"), F.col("span.end").alias("stop"))


@query("SELECT vec_id, round(n, 6) AS squared FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings) WHERE n >= 0.5")
def live_vectors(b: Base) -> DataFrame:
    v = b.table("embeddings").withColumn("n", dot(F.col("embedding"), F.col("embedding")))
    return v.where("n >= 0.5").select("vec_id", F.round("n", 6).alias("squared"))


@query("SELECT sha256(text) AS key, any_value(text) AS text FROM documents WHERE lang = 'es' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'es' AND doc_id % 2 = 0) GROUP BY 1")
def translation_misses(b: Base) -> DataFrame:
    es = b.docs.where("lang = 'es'")
    cache = es.where("doc_id % 2 = 0").select(F.lit("m").alias("model"), F.lit("es").alias("src"), F.lit("en").alias("tgt"), F.sha2("text", 256).alias("key"))
    return missing_translations(es, cache, "m", "es", "en").select("key", "text")


@query("SELECT (SELECT round(avg(ndcg10), 6) FROM metric) AS reported, round(avg(ndcg), 6) AS recomputed, count(*) AS n FROM metricx", "metric", "metricx")
def metric_recompute(b: Base) -> DataFrame:
    """The reported mean beside the mean of the values worked out anew from the ranked lists, which aren't rounded."""
    reported = search.summary(b.per_query).select(F.col("ndcg10_mean").alias("reported"), F.lit(1).alias("one"))
    anew = search.metrics(b.first_hundred, b.gold, b.items, places=12).agg(F.round(F.avg("ndcg10"), 6).alias("recomputed"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    return reported.join(anew, "one").drop("one")


@query("SELECT depth, 1.5::DOUBLE + 0.5::DOUBLE * depth AS linear, 1.5::DOUBLE * 2.0::DOUBLE ** depth AS exponential FROM (SELECT unnest(range(0, 8)) AS depth)")
def resolution_schedules(b: Base) -> DataFrame:
    d = b.spark.range(8).select(F.col("id").alias("depth"))
    return d.select("depth", (F.lit(1.5) + F.lit(0.5) * F.col("depth")).alias("linear"), (F.lit(1.5) * F.pow(F.lit(2.0), F.col("depth"))).alias("exponential"))


@query()
def gold_only_coverage(b: Base) -> DataFrame:
    """Items of which a relevant document holds any concept."""
    d = encode.matches(_rows(b), b.word_concept).select("id").distinct()
    return b.gold.join(d, "id", "left_semi").select("qid").distinct()


SQL["gold_only_coverage"] = sql("", "wc", "gold", "art").rstrip() + ", " + _MATCH + " SELECT DISTINCT qid FROM gold WHERE id IN (SELECT id FROM rows JOIN wc ON wc.lang = rows.lang AND wc.word = rows.token)"


@query()
def covered_view(b: Base) -> DataFrame:
    """The split files' items that are covered, in their order."""
    q = b.table("benchmark").select(F.col("item_id").alias("qid"), F.lit("eng-eng").alias("pair"))
    return search.hash_split(q, 10, 10, "42").join(coverage_of(b), "qid", "left_semi").select("pair", "split", "ord", "qid")


SQL["covered_view"] = SQL["coverage"].replace(" SELECT DISTINCT qc.qid FROM", ", cov AS (SELECT DISTINCT qc.qid FROM", 1) + """) SELECT pair, split, ord, qid FROM (
  SELECT pair, qid, CASE WHEN n <= 10 THEN 'dev' WHEN n <= 20 THEN 'validation' ELSE 'test' END AS split, CASE WHEN n <= 10 THEN n WHEN n <= 20 THEN n - 10 ELSE n - 20 END AS ord FROM (
  SELECT 'eng-eng' AS pair, item_id AS qid, row_number() OVER (ORDER BY sha256('42::eng-eng::' || item_id::VARCHAR), item_id) AS n FROM benchmark)) WHERE qid IN (SELECT qid FROM cov)"""


@query("SELECT concept_id, lang, count(*) AS n, round(avg(rank), 6) AS mean_rank FROM capped GROUP BY 1, 2", "capped")
def cap_report(b: Base) -> DataFrame:
    return sample.capped_places(sample.word_places(b.arts), b.word_concept).groupBy("concept_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"))


# Iterative and learned ------------------------------------------------------------------------------------------------


@query("SELECT node, component, component AS part FROM part", "part")
def louvain(b: Base) -> DataFrame:
    """The dictionary's components have four words at most, which no resolution here divides: communities are components. Graphs that divide are in the tests."""
    return b.communities.select("node", "component", "part")


@query()
def train_heads(b: Base) -> DataFrame:
    return train.train_heads(b.vec, train.Training(epochs=3, epoch_size=256)).select("concept_id", "n_rows", "first_loss", "last_loss")


@query()
def kmeans_best_k(b: Base) -> DataFrame:
    return train.kmeans_best(b.vec)


@query()
def concept_plane(b: Base) -> DataFrame:
    return train.plane(b.vec)


@query(f"""SELECT doc_id, token, (gaps + tokens - length(token))::BIGINT AS start, (gaps + tokens)::BIGINT AS stop FROM (
  SELECT doc_id, t[i] AS token, sum(length(g[i])) OVER w AS gaps, sum(length(t[i])) OVER w AS tokens FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t, regexp_split_to_array(lower(text), '{TOKEN}') AS g FROM art), unnest(range(1, len(t) + 1)) u(i) WINDOW w AS (PARTITION BY doc_id ORDER BY i))""", "art")
def token_positions(b: Base) -> DataFrame:
    return b.arts.select("doc_id", F.explode(token_spans("text")).alias("s")).select("doc_id", "s.token", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


@query("SELECT id, lang, concept_id, doc_id, sent_ord, word, sentence FROM points QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC, sent_ord DESC) = 1", "points")
def stream_ingest(b: Base) -> DataFrame:
    """Articles that come in the order of their ids, in four files and two batches."""
    at = f"{shared_dir(b.spark)}/stream-{uuid.uuid4().hex}"
    low, high = b.arts.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = -(-((high or 0) - (low or 0) + 1) // 4)
    for k in range(4):
        part = b.arts.where((F.col("doc_id") >= (low or 0) + k * step) & (F.col("doc_id") < (low or 0) + (k + 1) * step))
        part.select("lang", "doc_id", "text").coalesce(1).write.mode("append").parquet(f"{at}/in")
    b.word_concept.write.parquet(f"{at}/words")
    ingest.ingest(b.spark, f"{at}/in", b.spark.read.parquet(f"{at}/words"), f"{at}/out", f"{at}/checkpoint", files_per_batch=2)
    return ingest.stored(b.spark, f"{at}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bm25_top10"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import further, training  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
