"""The contract queries of this folder's operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, exact_dedup, lm, mixing, phrases, quality, rules, simhash, toxicity, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_passages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which items are found, with the items and edits; documents without any aren't listed."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "errors")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(rows))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.by_label(*codes.compress(table(spark, sf_dir, "embeddings")))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_mixing, op4_simhash, op5_exact_dedup, op6_decontamination, op7_lm, op8_url_filter, op9_quality, op10_chat, op11_codes, op12_rules, op13_phrases)}


_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), b AS (
  SELECT *, floor(log2(size + 1.0::DOUBLE) * 4)::INT AS band, h % 256 AS salt FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 3 AS cap FROM s
), w AS (
  SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight FROM r
), l AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER o, 0) AS cap_below, coalesce(sum(weight) OVER o, 0) AS weight_below
  FROM w WINDOW o AS (ORDER BY cap / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, (total - cap_below)::DOUBLE / (all_weight - weight_below)::DOUBLE AS level FROM l
), t AS (
  SELECT *, level * weight >= cap AS capped FROM v
), f AS (
  SELECT *, arg_min(level, cap_below) FILTER (NOT capped) OVER () AS free FROM t
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE free * weight END AS target FROM f
), p AS (
  SELECT b.doc_id, b.size, b.source, g.source_size, g.target,
         row_number() OVER (PARTITION BY b.source ORDER BY b.band, b.salt, b.size, b.h, b.doc_id) AS place
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
         ('0x' || substr(sha256('mix/offset:' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS u
  FROM p
)
SELECT doc_id, size, source_size, target,
       ((floor(rate * place::DOUBLE + u) - floor(rate * (place - 1)::DOUBLE + u)) * size)::BIGINT AS taken
FROM c
"""

_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AND row_number() OVER (PARTITION BY body, doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""

_CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r
), p AS (
  SELECT *, CASE WHEN role = before THEN length('<|im_turn|>') + length(safe)
                 ELSE length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1 END AS chars FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds as tables one after the other: (part, entry, c) codebooks and the vectors' nearest entries."""
    t = [
        """k AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"s AS MATERIALIZED (SELECT vec_id, label, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS x FROM k, range({parts}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM s WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
    ]
    for i in range(rounds + 1):
        near = "list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN range(1, len(x) + 1)])::BIGINT"
        t.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, p, x, min((d, e)) AS m FROM (SELECT vec_id, label, s.p, x, e, {near} AS d FROM s JOIN b{i} b ON s.p = b.p) GROUP BY ALL)")
        if i < rounds:
            mean = "SELECT p, m[2] AS e, j, sum(x[j])::HUGEINT AS t, count(*)::HUGEINT AS n FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS j FROM a{0}) GROUP BY ALL"
            floor = "CASE WHEN t < 0 THEN -((-t + n - 1) // n) ELSE t // n END"
            t.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(y.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, e, list(({floor})::BIGINT ORDER BY j) AS c FROM ({mean.format(i)}) GROUP BY p, e) y ON b.p = y.p AND b.e = y.e)")
    return "WITH " + ", ".join(t) + f""", o AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM o"""


_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?
-]')), '[^ 	]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) r(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 10),
x AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, cut, fl.n AS l, fr.n AS r, (1000000::HUGEINT * x.a * x.a // (fl.n::HUGEINT * fr.n))::BIGINT AS score
      FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, t.n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * b.a QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _MIXING, "op5_exact_dedup": _DEDUP, "op10_chat": _CHAT, "op11_codes": _codes_sql(), "op13_phrases": _PHRASES}
