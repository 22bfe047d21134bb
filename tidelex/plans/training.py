"""Queries for training inputs, heads learned from them, and encoding with heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLAIN, TOKEN, plain_tokens
from ..operators import encode, graph, inputs, train, vocab
from ..sources.store import shared_dir
from .base import Base
from .catalog import _matched, long
from .register import query
from .registry import DigestVectors
from .sql import STOP

PASSAGE = "passage: "
INPUT, TEACHER = DigestVectors(16), DigestVectors(32)


def digest_sql(text: str, dim: int) -> str:
    """The stand-in's vector of a text, before it is brought to unit length."""
    return f"[('0x' || substr(sha1({text}), i, 1))::INT - 7.5::DOUBLE for i in range(1, {dim + 1})]"


def unit_sql(x: str) -> str:
    return f"[e / greatest(sqrt(list_dot_product({x}, {x})), 1e-12::DOUBLE) for e in {x}]"


def pooled_sql(occurrences: str, keys: str, dim: int) -> str:
    """occurrences(keys..., token) -> (keys..., n_spans, x): the mean of the tokens' unit vectors, to unit length. Each token's vector is worked out once, a row for each place."""
    each = ", ".join(f"sum(u[{i}] * n)" for i in range(1, dim + 1))
    return f"""(SELECT {keys}, n_spans, {unit_sql('y')} AS x FROM (SELECT {keys}, sum(n)::BIGINT AS n_spans, [{each}] AS y FROM (SELECT {keys}, token, count(*) AS n FROM {occurrences} GROUP BY ALL) o
      JOIN (SELECT token, {unit_sql('d')} AS u FROM (SELECT DISTINCT token, {digest_sql('token', dim)} AS d FROM {occurrences})) USING (token) GROUP BY {keys}))"""


def teacher(b: Base, points: DataFrame) -> DataFrame:
    """(id, m): the stored vectors of sentences."""
    return encode.sentence_vectors(points, TEACHER, PASSAGE).select("id", F.col("x").alias("m"))


_STORED = f"""stored AS MATERIALIZED (SELECT id, lang, concept_id, word, sentence FROM points QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id * 1000000 + sent_ord DESC) = 1),
  enough AS MATERIALIZED (SELECT * FROM stored QUALIFY count(*) OVER (PARTITION BY concept_id) >= 10),
  occ AS MATERIALIZED (SELECT k.concept_id, k.lang, k.sentence, k.token FROM (SELECT *, unnest(regexp_extract_all(lower(sentence), '{TOKEN}')) AS token FROM (SELECT DISTINCT concept_id, lang, sentence FROM enough)) k
    JOIN wc ON wc.lang = k.lang AND wc.word = k.token AND wc.concept_id = k.concept_id),
  pool AS MATERIALIZED {pooled_sql('occ', 'concept_id, lang, sentence', 16)},
  located AS (SELECT e.id, e.concept_id, e.lang, n_spans, x, {unit_sql('m')} AS m FROM (SELECT *, {digest_sql("'" + PASSAGE + "' || sentence", 32)} AS m FROM enough) e JOIN pool USING (concept_id, lang, sentence)
    QUALIFY count(*) OVER (PARTITION BY e.concept_id) >= 10),
  turns AS (SELECT *, row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) AS rn, least(count(*) FILTER (lang = 'en') OVER (PARTITION BY concept_id), count(*) FILTER (lang = 'es') OVER (PARTITION BY concept_id)) AS both_n FROM located),
  ready AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY rn > both_n, rn, lang) AS pos FROM turns)"""


@query("SELECT concept_id, pos, id, lang, n_spans, round(x[1], 6) AS x_first, round(x[16], 6) AS x_last, round(m[1], 6) AS m_first, round(m[32], 6) AS m_last FROM ready", "points", "wc", also=_STORED)
def train_inputs(b: Base) -> DataFrame:
    """Each stored row that its concept's surface forms are found in, in training order, with the vector to learn on and the one to mine in."""
    rows = inputs.training_rows(b.stored, b.word_concept, INPUT, teacher(b, b.stored))
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return rows.select("concept_id", "pos", "id", "lang", "n_spans", at("x", 0).alias("x_first"), at("x", 15).alias("x_last"), at("m", 0).alias("m_first"), at("m", 31).alias("m_last"))


_TRIMMED = r"""parts AS (SELECT s.*, regexp_split_to_array(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '\s+') AS p, f.forms FROM stored s JOIN (SELECT concept_id, lang, list(word) AS forms FROM wc GROUP BY 1, 2) f USING (concept_id, lang)),
  spots AS (SELECT *, list_min(list_filter([list_position(list_transform(p, lambda w: lower(regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g'))), f) for f in forms], lambda k: k > 0)) AS k FROM parts),
  copies AS (SELECT id, concept_id, lang, array_to_string(p[greatest(k - 5, 1):k + 5], ' ') AS trimmed, sentence FROM spots WHERE k IS NOT NULL),
  tocc AS MATERIALIZED (SELECT c.id, c.concept_id, c.token FROM (SELECT *, unnest(regexp_extract_all(lower(trimmed), '""" + TOKEN + r"""')) AS token FROM copies WHERE trimmed <> sentence) c JOIN wc ON wc.lang = c.lang AND wc.word = c.token AND wc.concept_id = c.concept_id),
  tpool AS """ + pooled_sql("tocc", "id, concept_id", 16)


@query("SELECT 't:' || id AS id, id AS source, concept_id, c.lang, trimmed AS sentence, n_spans, round(x[1], 6) AS x_first FROM copies c JOIN tpool USING (id, concept_id)", "points", "wc", also=_STORED + ", " + _TRIMMED)
def augmented_copies(b: Base) -> DataFrame:
    """Every row's copy cut around its concept's first form, with the vector of what is left."""
    copies = graph.cut(inputs.augmented_inputs(b.stored, b.word_concept))  # read several times
    keyed = copies.select(F.concat_ws("|", "id", "concept_id").alias("key"), "concept_id", "lang", "sentence")
    x = inputs.own_token_vectors(keyed.select(F.col("key").alias("id"), "lang", F.col("sentence").alias("text")), b.word_concept, INPUT, keyed.select(F.col("key").alias("id"), "concept_id"))
    j = keyed.join(x.select(F.col("id").alias("key"), "concept_id", "n_spans", F.round(F.get("x", F.lit(0)), 6).alias("x_first")), ["key", "concept_id"])
    own = F.substring_index("key", "|", 1)  # row ids are hexadecimal
    return j.select(own.alias("id"), F.substr(own, F.lit(3)).alias("source"), "concept_id", "lang", "sentence", "n_spans", "x_first")


def demanded(b: Base, mark: float = 0.8) -> DataFrame:
    """(concept_id): the concepts that queries ask for most, up to a share of all they ask for."""
    return vocab.demand_choice(vocab.demand(_matched(b)), mark).select("concept_id")


def selected(b: Base) -> DataFrame:
    """The stored rows of the demanded concepts, found from their words alone."""
    return b.stored_of(graph.cut(b.word_concept.join(demanded(b), "concept_id", "left_semi")))


@query()
def train_selected(b: Base) -> DataFrame:
    """Heads of the concepts that queries ask for most, learned on pooled tokens of rows and their cut copies, which are prepared once, and mined by sentence vectors, with margins of each concept's own spread."""
    points = graph.cut(selected(b))  # read several times
    rows = inputs.prepared(b.spark, f"{shared_dir(b.spark)}/recipes", points, b.word_concept, INPUT, teacher(b, points), ratio=1.0)
    return train.train_heads(rows, train.Training(epochs=3, epoch_size=256, margin_scale=1.0)).select("concept_id", "n_rows", F.round("margin", 6).alias("margin"), "first_loss", "last_loss")


def fixed_heads(b: Base, dim: int = INPUT.dim) -> DataFrame:
    """(concept_id, weights): heads by a formula, in the place of trained ones, for three concepts of four."""
    c = F.substring("concept_id", 3, 20).cast("long")
    w = F.transform(F.sequence(long(0), long(7)), lambda o: F.transform(F.sequence(long(0), long(dim - 1)), lambda i: ((o * dim + i * 7 + c) % 13 - 6) / F.lit(10.0)))
    return b.vocab.where(c % 4 != 3).select("concept_id", w.alias("weights"))


def learned(b: Base, heads: DataFrame, rows: DataFrame, texts: DataFrame, is_query: bool, backbone_weight: float = 1.0, provider=INPUT) -> DataFrame:
    """rows(id, lang, length, token, term) and texts(id, lang, text) -> (id, idx, value): sparse vectors in learned mode. Only concepts with a head leave the backbone."""
    known = b.word_concept.join(heads.select("concept_id"), "concept_id", "left_semi")
    x = inputs.own_token_vectors(texts, known, provider).select("id", "concept_id", "x")
    return encode.encode_sparse(rows, known, is_query, backbone_weight, x.join(heads, "concept_id"))


_HEAD = "[tanh(list_dot_product(x, [(((o * 16 + i * 7 + substr(concept_id, 3)::BIGINT) % 13) - 6) / 10.0::DOUBLE for i in range(0, 16)])) for o in range(0, 8)]"
_HEADED = f"""known AS MATERIALIZED (FROM wc WHERE substr(concept_id, 3)::BIGINT % 4 <> 3),
  htf AS (SELECT id, lang, length, term, count(*) AS tf FROM dterm t WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.lang = t.lang AND k.word = t.token) GROUP BY ALL),
  hctf AS (SELECT id, t.lang, length, m.concept_id, count(*) AS tf FROM dterm t JOIN known m ON m.lang = t.lang AND m.word = t.token GROUP BY ALL),
  hocc AS MATERIALIZED (SELECT t.id, m.concept_id, t.token FROM (SELECT doc_id AS id, lang, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM documents) t JOIN known m ON m.lang = t.lang AND m.word = t.token),
  hpool AS MATERIALIZED {pooled_sql('hocc', 'id, concept_id', 16)},
  hout AS (SELECT id, concept_id, substr(concept_id, 3)::BIGINT AS c, x, {_HEAD} AS y FROM hpool)"""

_BM25 = "round(tf::DOUBLE * 2.2::DOUBLE / (tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / 256.0::DOUBLE)), 6)"
_BLOCK = "y[i] / greatest(sqrt(list_dot_product(y, y)), 1e-6::DOUBLE) * w"


#: hvec(id, idx, value): documents in learned mode; hqvec(ql, qid, idx, value, words): queries, by language, and whether a value is of the backbone.
LEARNED = _HEADED + f""",
  hvec AS (SELECT id, idx, arg_max({_BM25}, term) AS value FROM htf JOIN idx USING (term) GROUP BY 1, 2 UNION ALL
    SELECT id, 8 * c + i - 1, round({_BLOCK}, 6) FROM (SELECT o.*, {_BM25} AS w FROM hout o JOIN hctf n ON n.id = o.id AND n.concept_id = o.concept_id), range(1, 9) t(i) WHERE abs({_BLOCK}) > 1e-6),
  two AS (SELECT unnest(['en', 'es']) AS ql),
  hqocc AS MATERIALIZED (SELECT ql, t.qid, m.concept_id, t.token FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM benchmark) t, two JOIN known m ON m.lang = ql AND m.word = t.token),
  hqpool AS {pooled_sql('hqocc', 'ql, qid, concept_id', 16)},
  hqout AS (SELECT ql, qid, concept_id, substr(concept_id, 3)::BIGINT AS c, 1.0::DOUBLE AS w, {_HEAD} AS y FROM hqpool),
  hqkept AS (SELECT DISTINCT ql, qid, m.concept_id FROM qstem p, two JOIN known m ON m.lang = ql AND m.word = p.token),
  hqvec AS (SELECT DISTINCT ql, qid, idx, 1.0::DOUBLE AS value, true AS words FROM qstem p JOIN idx USING (term), two WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.lang = ql AND k.word = p.token)
    UNION ALL SELECT ql, qid, 8 * c + i - 1, round({_BLOCK}, 6), false FROM hqout JOIN hqkept USING (ql, qid, concept_id), range(1, 9) t(i) WHERE abs({_BLOCK}) > 1e-6)"""


@query("SELECT id, idx, value FROM hvec", "dterm", "wc", "idx", "qstem", also=LEARNED)
def encode_learned(b: Base) -> DataFrame:
    """Each document's whole vector in learned mode, with heads by a formula: blocks of eight values, weighted as the words that they displace."""
    lang = b.docs.select(F.col("doc_id").alias("id"), "lang", "text")
    return learned(b, fixed_heads(b), b.doc_tokens.join(lang.select("id", "lang"), "id"), lang, False)


# Tokens and spans -------------------------------------------------------------------------------------------------------


@query(rf"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{PLAIN}'), lambda t: t NOT IN ({STOP}) AND length(t) <= 40)) AS token FROM documents) GROUP BY ALL")
def plain_terms(b: Base) -> DataFrame:
    """The backbone's tokens by the rule that keeps digits: what isn't a letter, number or underscore parts them."""
    rows = encode.token_rows(b.docs.select(F.col("doc_id").alias("id"), "text"), stems=None, tokenise=plain_tokens)
    return rows.groupBy(F.col("id").alias("doc_id"), "token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT p.doc_id AS id, concept_id, (stop - length(token) + 9)::BIGINT AS start, (stop + 9)::BIGINT AS stop FROM (
  SELECT doc_id, lang, t[i] AS token, sum(length(g[i])) OVER w + sum(length(t[i])) OVER w AS stop FROM (
    SELECT doc_id, lang, regexp_extract_all(lower(text), '{TOKEN}') AS t, regexp_split_to_array(lower(text), '{TOKEN}') AS g FROM art), unnest(range(1, len(t) + 1)) u(i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) p
  JOIN wc ON wc.lang = p.lang AND wc.word = p.token""", "art", "wc")
def concept_spans(b: Base) -> DataFrame:
    """Every place of a concept's surface forms, in characters of the prefixed text."""
    s = encode.concept_spans(b.arts.select(F.col("doc_id").alias("id"), "lang", "text"), b.word_concept, PASSAGE)
    return s.select("id", "concept_id", "start", F.col("end").alias("stop"))


_FOCAL = f"""fp AS MATERIALIZED (SELECT DISTINCT id, word, lower('{PASSAGE}' || sentence) AS s FROM points),
  fs AS (SELECT id, strpos(s, word) - 1 AS a, strpos(s, word) - 1 + length(word) AS z, regexp_extract_all(s, '{TOKEN}') AS t, regexp_split_to_array(s, '{TOKEN}') AS g FROM fp),
  ft AS (SELECT id, a, z, t[i] AS token, sum(length(g[i])) OVER w + sum(length(t[i])) OVER w AS stop FROM fs, unnest(range(1, len(t) + 1)) u(i) WINDOW w AS (PARTITION BY id ORDER BY i)),
  fh AS MATERIALIZED (SELECT id, token FROM ft WHERE a >= 0 AND stop - length(token) < z AND stop > a),
  fv AS {pooled_sql('fh', 'id', 16)}"""


@query("SELECT fp.id, round(coalesce(x[1], 0), 6) AS x_first, round(coalesce(x[16], 0), 6) AS x_last FROM fp LEFT JOIN fv ON fv.id = fp.id", "points", also=_FOCAL)
def focal_vectors(b: Base) -> DataFrame:
    """The vector of each row's focal word where it first stands, zeros where it doesn't."""
    v = encode.focal_vectors(b.points.select("id", "word", "sentence"), INPUT, PASSAGE)
    at = lambda i: F.round(F.get("x", F.lit(i)), 6)
    return v.select("id", at(0).alias("x_first"), at(15).alias("x_last"))


# Communities -------------------------------------------------------------------------------------------------------------

_LINKED = """sdict AS (SELECT 'en-es' AS dir, (a.i * 64 + a.bucket) * 2 + 1 AS ord, a.word AS src, z.word AS tgt FROM ranked a JOIN ranked z ON z.lang = 'es' AND z.bucket = a.bucket AND z.i = a.i WHERE a.lang = 'en'
  UNION ALL SELECT 'en-es', (a.i * 64 + a.bucket) * 2 + 2, a.word, z.word FROM ranked a JOIN ranked z ON z.lang = 'es' AND z.bucket = a.bucket AND z.i = xor(a.i, 1) WHERE a.lang = 'en' AND a.i % 3 <> 0
  UNION ALL SELECT 'en-es', (a.i * 64 + a.bucket) * 2 + 2, a.word, z.word FROM ranked a JOIN ranked z ON z.lang = 'es' AND z.bucket = (a.bucket + 1) % 64 AND z.i = a.i // 4 WHERE a.lang = 'en' AND a.i % 3 = 0
  UNION ALL SELECT 'es-en', (a.i * 64 + a.bucket) * 2 + 1, a.word, z.word FROM ranked a JOIN ranked z ON z.lang = 'en' AND z.bucket = a.bucket AND z.i = a.i WHERE a.lang = 'es'
  UNION ALL SELECT 'es-en', (a.i * 64 + a.bucket) * 2 + 2, a.word, z.word FROM ranked a JOIN ranked z ON z.lang = 'en' AND z.bucket = a.bucket AND z.i = xor(a.i, 1) WHERE a.lang = 'es'),
  stop2 AS (SELECT dir, src, tgt FROM sdict QUALIFY row_number() OVER (PARTITION BY dir, src ORDER BY ord) <= 2),
  sedge AS (SELECT 'en:' || CASE WHEN dir = 'en-es' THEN src ELSE tgt END AS u, 'es:' || CASE WHEN dir = 'en-es' THEN tgt ELSE src END AS v, count(*) AS weight FROM stop2 GROUP BY 1, 2)"""


@query("SELECT u, v, weight FROM sedge", "ranked", also=_LINKED)
def linked_edges(b: Base) -> DataFrame:
    """The graph of a dictionary with synonyms and words of many senses, which components don't divide."""
    return b.linked_edges


@query()
def linked_communities(b: Base) -> DataFrame:
    return b.linked_communities


@query("SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT u FROM sedge UNION SELECT v FROM sedge)) AS nodes, 0::BIGINT AS improving, 0::BIGINT AS oversized, true AS divides FROM sedge", "ranked", also=_LINKED)
def community_certificate(b: Base) -> DataFrame:
    """What has to hold of communities, whatever the order of moves: no move of a single word improves modularity before large ones are divided; after that none is above the limit
    unless it can't be divided; and there are more of them than components."""
    links = b.linked_edges
    whole = graph.cut(graph.louvain_parts(links, b.linked_whole, most=1 << 60))
    better = graph.improving(links, whole.select("node", F.col("part").alias("component"))).agg(F.count(F.lit(1)).alias("improving"))
    size = b.linked_communities.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"), F.max("stuck").alias("stuck"))
    each = size.agg(F.count_if((F.col("n") > 20) & ~F.col("stuck")).alias("oversized"), (F.count(F.lit(1)) > F.count_distinct("component")).alias("divides"))
    nodes = whole.agg(F.count(F.lit(1)).alias("nodes"))
    return graph.side_by_side(links.agg(F.count(F.lit(1)).alias("edges")), nodes, better, each)


@query()
def linked_recall(b: Base) -> DataFrame:
    """Communities made without a tenth of the edges: how many of these have both ends placed, and the share of them in one community."""
    e = graph.cut(graph.held_out(b.linked_edges))
    rest = e.where("not held").drop("held")
    parts = graph.louvain_parts(rest, graph.components(rest)).select("node", F.col("part").alias("component"))
    return graph.recall_of(e.where("held"), parts)


@query()
def linked_schedules(b: Base) -> DataFrame:
    """Two schedules of resolution on a graph that they have to divide: parts, the depths they were made at, and the better modularity."""
    return graph.schedules(b.linked_edges, b.linked_whole, {"linear": graph.linear(0.5), "exponential": graph.exponential(2.0)})
