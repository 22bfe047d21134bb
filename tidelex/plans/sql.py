"""Common table expressions for the DuckDB side of the comparisons, put together by name."""

from __future__ import annotations

from ..functions.text import ENTRY, TOKEN, WORD
from ..operators.encode import STOPWORDS
from . import stem_sql

STOP = ", ".join(f"'{w}'" for w in STOPWORDS["en"])
STOP_ES = ", ".join(f"'{w}'" for w in STOPWORDS["es"])

BM25 = "round(tf::DOUBLE * 2.2::DOUBLE / (tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / 256.0::DOUBLE)), 6)"

#: name: (names it needs, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "art": ((), "SELECT lang, doc_id, text FROM documents WHERE lang IN ('en', 'es')"),
    "sents": (("art",), r"""
        SELECT lang, doc_id, i - 1 AS sent_ord, l[i] AS sentence FROM (
          SELECT lang, doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)),
                 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM art), unnest(range(1, len(l) + 1)) t(i)"""),
    "longer": (("art",), r"""
        SELECT lang, doc_id, i - 1 AS sent_ord, l[i] AS sentence FROM (
          SELECT lang, doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)),
                 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM art WHERE length(text) >= 50), unnest(range(1, len(l) + 1)) t(i)"""),
    "good": (("longer",), f"SELECT * FROM (SELECT *, list_distinct(regexp_extract_all(lower(sentence), '{WORD}')) AS words FROM longer) WHERE len(words) BETWEEN 5 AND 100"),
    "ranked": (("art",), f"""
        SELECT lang, word, bucket, row_number() OVER (PARTITION BY lang, bucket ORDER BY df DESC, word) - 1 AS i FROM (
          SELECT lang, word, ('0x' || substr(sha1(word), 1, 2))::BIGINT % 64 AS bucket, count(*) AS df FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS word FROM art)
          WHERE length(word) >= 2 AND regexp_matches(word, '{ENTRY}') GROUP BY 1, 2)"""),
    "dict": (("ranked",), """
        SELECT 'en-es' AS dir, (a.i * 64 + a.bucket) * 2 + 1 AS ord, a.word AS src, b.word AS tgt FROM ranked a JOIN ranked b ON a.i = b.i AND a.bucket = b.bucket AND a.lang = 'en' AND b.lang = 'es'
        UNION ALL SELECT 'en-es', (a.i * 64 + a.bucket) * 2 + 2, a.word, b.word FROM ranked a JOIN ranked b ON a.i = b.i - 1 AND a.bucket = b.bucket AND a.lang = 'en' AND b.lang = 'es' WHERE a.i % 3 = 0
        UNION ALL SELECT 'es-en', (a.i * 64 + a.bucket) * 2 + 1, b.word, a.word FROM ranked a JOIN ranked b ON a.i = b.i AND a.bucket = b.bucket AND a.lang = 'en' AND b.lang = 'es'"""),
    "top": (("dict",), f"""
        SELECT *, row_number() OVER (PARTITION BY dir, src ORDER BY ord) AS rank FROM dict
        WHERE length(src) >= 2 AND length(tgt) >= 2 AND regexp_matches(src, '{ENTRY}') AND regexp_matches(tgt, '{ENTRY}') QUALIFY rank <= 2"""),
    "edge": (("top",), """
        SELECT u, v, count(*) AS weight FROM (SELECT 'en:' || CASE WHEN dir = 'en-es' THEN src ELSE tgt END AS u,
          'es:' || CASE WHEN dir = 'en-es' THEN tgt ELSE src END AS v FROM top) GROUP BY 1, 2"""),
    "sym": (("edge",), "SELECT u, v FROM edge UNION SELECT v, u FROM edge"),
    "reach": (("sym",), "SELECT u AS n, u AS m FROM sym UNION SELECT r.n, s.v FROM reach r JOIN sym s ON r.m = s.u"),
    "part": (("reach",), "SELECT n AS node, min(m) AS component FROM reach GROUP BY 1"),
    "tsym": (("edge",), "SELECT u, v FROM (SELECT u, v FROM edge WHERE ('0x' || substr(sha1(u || '|' || v), 1, 8))::BIGINT % 10 >= 1) UNION SELECT v, u FROM edge WHERE ('0x' || substr(sha1(u || '|' || v), 1, 8))::BIGINT % 10 >= 1"),
    "treach": (("tsym",), "SELECT u AS n, u AS m FROM tsym UNION SELECT r.n, s.v FROM treach r JOIN tsym s ON r.m = s.u"),
    "tpart": (("treach",), "SELECT n AS node, min(m) AS component FROM treach GROUP BY 1"),
    "cluster": (("part",), """
        SELECT component, coalesce(list_sort(list(DISTINCT substr(node, 4)) FILTER (node LIKE 'en:%')), []) AS en,
          coalesce(list_sort(list(DISTINCT substr(node, 4)) FILTER (node LIKE 'es:%')), []) AS es FROM part GROUP BY 1"""),
    "concept": (("cluster",), """
        SELECT printf('C-%05d', row_number() OVER (ORDER BY size DESC, en[1]) - 1) AS concept_id, en, es, size FROM (
          SELECT *, len(en) + len(es) AS size FROM cluster) WHERE len(en) > 0 AND len(es) > 0 AND size >= 2"""),
    "wc": (("concept",), "SELECT 'en' AS lang, unnest(en) AS word, concept_id FROM concept UNION ALL SELECT 'es', unnest(es), concept_id FROM concept"),
    "hits": (("good", "wc"), "SELECT g.lang, g.doc_id, g.sent_ord, g.sentence, g.word, wc.concept_id FROM (SELECT *, unnest(words) AS word FROM good) g JOIN wc ON g.lang = wc.lang AND g.word = wc.word"),
    "counts": (("hits",), "SELECT lang, concept_id, count(*) AS n FROM hits GROUP BY 1, 2"),
    "supply": (("concept", "counts"), """
        SELECT c.concept_id, c.en, c.es, c.size, coalesce(a.n, 0) AS en_n, coalesce(b.n, 0) AS es_n FROM concept c
        LEFT JOIN counts a ON a.concept_id = c.concept_id AND a.lang = 'en' LEFT JOIN counts b ON b.concept_id = c.concept_id AND b.lang = 'es'"""),
    "capped": (("hits",), """
        SELECT lang, doc_id, sent_ord, sentence, word, concept_id, row_number() OVER (PARTITION BY lang, concept_id ORDER BY doc_id, sent_ord, word) AS rank FROM (
          SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY lang, doc_id, concept_id ORDER BY sent_ord, word) <= 2) QUALIFY rank <= 100"""),
    "points": (("capped",), """
        SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (
          SELECT *, sha256(lang || ':' || word || ':' || sentence) AS h FROM capped)"""),
    "latest": (("points",), "SELECT id, lang, concept_id, word, doc_id, sent_ord FROM points QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id * 1000000 + sent_ord DESC) = 1"),
    "balanced": (("latest",), """
        SELECT id, lang, concept_id FROM (SELECT *, count(*) FILTER (lang = 'en') OVER w AS n_en, count(*) FILTER (lang = 'es') OVER w AS n_es,
          row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) AS rn FROM latest WINDOW w AS (PARTITION BY concept_id))
        WHERE rn <= CASE WHEN n_en = 0 OR n_es = 0 THEN n_en + n_es WHEN lang = 'en' THEN floor((n_en + n_es) * 0.5::DOUBLE) ELSE n_en + n_es - floor((n_en + n_es) * 0.5::DOUBLE) END"""),
    "ordered": (("balanced",), """
        SELECT id, lang, concept_id, row_number() OVER (PARTITION BY concept_id ORDER BY rn > both_n, rn, lang) AS pos FROM (
          SELECT *, row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) AS rn,
            least(count(*) FILTER (lang = 'en') OVER (PARTITION BY concept_id), count(*) FILTER (lang = 'es') OVER (PARTITION BY concept_id)) AS both_n FROM balanced)"""),
    # Retrieval: all documents, benchmark items as queries.
    "dtok": ((), rf"SELECT doc_id AS id, lang, list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda t: t NOT IN ({STOP}) AND length(t) <= 40) AS toks FROM documents"),
    "dword": (("dtok",), "SELECT id, lang, len(toks) AS length, unnest(toks) AS token FROM dtok"),
    "qtok": ((), rf"SELECT item_id AS qid, list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda t: t NOT IN ({STOP}) AND length(t) <= 40) AS toks FROM benchmark"),
    "qword": (("qtok",), "SELECT qid, unnest(toks) AS token FROM qtok"),
    "anyword": (("dword", "qword"), "SELECT token FROM dword UNION SELECT token FROM qword"),
    "stems": (("anyword",), stem_sql.stems("anyword")),
    "dterm": (("dword", "stems"), "SELECT id, lang, length, token, stem AS term FROM dword JOIN stems USING (token)"),
    "dtf": (("dterm",), "SELECT id, lang, length, term, count(*) AS tf FROM dterm GROUP BY ALL"),
    "dpost": (("dtf",), f"SELECT id, lang, term, {BM25} AS d FROM dtf"),
    "qstem": (("qword", "stems"), "SELECT qid, token, stem AS term FROM qword JOIN stems USING (token)"),
    "qterm": (("qstem",), "SELECT DISTINCT qid, term, 1.0::DOUBLE AS q FROM qstem"),
    "termset": (("dterm", "qstem"), "SELECT term FROM dterm UNION SELECT term FROM qstem"),
    "idx": (("termset",), stem_sql.indices("termset")),
    "trans": (("dict",), "SELECT src, arg_min(tgt, ord) AS tgt FROM dict WHERE dir = 'en-es' GROUP BY 1"),
    "transd": (("dict",), "SELECT dir, src, arg_min(tgt, ord) AS tgt FROM dict GROUP BY 1, 2"),
    "trword": (("qword", "transd"), "SELECT token FROM qword UNION SELECT tgt FROM transd JOIN qword ON src = token"),
    "trstem": (("trword",), stem_sql.stems("trword")),
    "run100": (("dpost", "qterm"), """
        SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
          SELECT q.qid, p.id, round(sum(ln(1.0::DOUBLE + ((SELECT count(*) FROM documents) - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * q.q * p.d), 6) AS score
          FROM qterm q JOIN dpost p ON q.term = p.term JOIN (SELECT term, count(*) AS df FROM dpost GROUP BY 1) f ON f.term = p.term GROUP BY 1, 2) QUALIFY rank <= 100"""),
    "run": (("run100",), "FROM run100 WHERE rank <= 10"),
    "gold": ((), "SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''"),
    # Lexical mode: concept words of a language leave the backbone, their concepts take their places.
    "ltf": (("dterm", "wc"), "SELECT id, lang, length, term, count(*) AS tf FROM dterm t WHERE NOT EXISTS (SELECT 1 FROM wc WHERE wc.lang = t.lang AND wc.word = t.token) GROUP BY ALL"),
    "lctf": (("dterm", "wc"), "SELECT id, t.lang, length, m.concept_id, count(*) AS tf FROM dterm t JOIN wc m ON m.lang = t.lang AND m.word = t.token GROUP BY ALL"),
    "lex": (("ltf", "lctf"), f"SELECT id, lang, 't:' || term AS term, {BM25} AS d FROM ltf UNION ALL SELECT id, lang, 'c:' || concept_id, {BM25} FROM lctf"),
    "ql": ((), "SELECT unnest(['en', 'es']) AS ql"),
    "lexq": (("qstem", "wc", "ql"), """
        SELECT DISTINCT ql, qid, 't:' || term AS term, 1.0::DOUBLE AS q FROM qstem p, ql WHERE NOT EXISTS (SELECT 1 FROM wc WHERE wc.lang = ql AND wc.word = p.token)
        UNION ALL SELECT DISTINCT ql, qid, 'c:' || m.concept_id, 1.0::DOUBLE FROM qstem p, ql JOIN wc m ON m.lang = ql AND m.word = p.token"""),
    "ideal": (("gold",), "SELECT qid, count(*) AS relevant, list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) for i in range(1, least(count(*), 10) + 1)]) AS ideal FROM gold GROUP BY 1"),
    "metricx": (("run100", "gold", "ideal"), """
        SELECT b.item_id AS qid, coalesce(dcg / ideal, 0) AS ndcg, coalesce(found / relevant::DOUBLE, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr FROM benchmark b LEFT JOIN ideal n ON n.qid = b.item_id
        LEFT JOIN (SELECT r.qid, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 10) AS dcg, count(*) FILTER (rank <= 100) AS found, min(rank) FILTER (rank <= 10) AS first
          FROM run100 r JOIN gold g ON g.qid = r.qid AND g.id = r.id GROUP BY 1) h ON h.qid = b.item_id"""),
    "metric": (("metricx",), "SELECT qid, round(ndcg, 6) AS ndcg10, round(recall, 6) AS r100, round(mrr, 6) AS mrr10 FROM metricx"),
    # Vectors: a label is a concept, the id's parity a language.
    "allvec": ((), "SELECT 'L-' || label AS concept_id, vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'es' END AS lang, embedding::DOUBLE[] AS x FROM embeddings"),
    "vec": (("allvec",), "FROM allvec QUALIFY row_number() OVER (PARTITION BY concept_id, lang ORDER BY id) <= 2000"),
    "pairs": (("vec",), """
        SELECT a.concept_id, a.id AS a, b.id AS b, a.lang AS lang_a, b.lang AS lang_b, round(1.0::DOUBLE - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)) + 1e-8::DOUBLE), 6) AS dist
        FROM vec a JOIN vec b ON a.concept_id = b.concept_id AND a.id <> b.id"""),
    "allpairs": (("allvec",), """
        SELECT a.concept_id, a.id AS a, b.id AS b, a.lang AS lang_a, b.lang AS lang_b, round(1.0::DOUBLE - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)) + 1e-8::DOUBLE), 6) AS dist
        FROM allvec a JOIN allvec b ON a.concept_id = b.concept_id AND a.id <> b.id"""),
    "grid": (("allpairs",), """
        WITH r AS (SELECT *, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY concept_id, a, lang_b) AS m FROM allpairs WINDOW w AS (PARTITION BY concept_id, a, lang_b ORDER BY dist, b)),
        k AS (SELECT *, least(20, greatest(1, m // 3)) AS k FROM r WHERE m >= 3)
        SELECT p.concept_id, p.a, p.lang_a, p.lang_b, p.rank AS pos_rank, p.b AS pos, arg_min(n.b, n.rank) AS neg, round(min(n.dist) - p.dist, 6) AS gap
        FROM k p JOIN k n ON p.concept_id = n.concept_id AND p.a = n.a AND p.lang_b = n.lang_b AND p.rank < p.k AND n.rank >= n.k AND n.dist >= round(p.dist + 0.05::DOUBLE, 6)
        GROUP BY p.concept_id, p.a, p.lang_a, p.lang_b, p.rank, p.b, p.dist"""),
    "five": (("grid",), """
        SELECT s.concept_id, s.a, s.pos AS sl_pos, s.neg AS sl_neg, coalesce(x.pos, s.a) AS xl_pos, coalesce(x.neg, s.a) AS xl_neg, s.gap AS margin_sl, coalesce(x.gap, 0.0::DOUBLE) AS margin_xl, x.pos IS NOT NULL AS has_xl
        FROM (FROM grid WHERE pos_rank = 0 AND lang_a = lang_b) s LEFT JOIN (FROM grid WHERE pos_rank = 0 AND lang_a <> lang_b) x ON s.concept_id = x.concept_id AND s.a = x.a"""),
}


def sql(body: str, *names: str) -> str:
    """body after a WITH clause of the named parts and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body if order else body
