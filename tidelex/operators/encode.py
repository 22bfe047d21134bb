"""Sparse encoding: BM25 terms of a text's tokens, and concept terms in their place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import lexical_index
from ..functions.stem import stem_of, stems_of
from ..functions.text import focal_tokens, token_spans, tokens
from ..functions.vector import head, norm, unit
from .graph import cut

EPSILON = 1e-6


@dataclass(frozen=True)
class Bm25:
    k: float = 1.2
    b: float = 0.75
    avg_len: float = 256.0
    max_token: int = 40


#: An explicit stop list, the same on both sides of every comparison.
STOPWORDS = {"en": ("the", "of", "and", "to", "in", "is", "it", "that", "as", "for", "with", "on", "be", "by", "this", "was", "are", "or", "an", "a"), "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo", "como")}


def bm25(tf: Column, length: Column, p: Bm25 = Bm25()) -> Column:
    return tf * F.lit(p.k + 1) / (tf + F.lit(p.k) * (F.lit(1 - p.b) + F.lit(p.b) * length / F.lit(p.avg_len)))


def token_rows(docs: DataFrame, stop: tuple[str, ...] = STOPWORDS["en"], p: Bm25 = Bm25(), stems: Callable[[Column], Column] | None = stems_of, tokenise: Callable[[Column], Column] = tokens, also: tuple[str, ...] = ()) -> DataFrame:
    """docs(id, text) -> (id, length, token, term): a row for each kept token, with its stem as the term (itself without stems); length counts
    all kept tokens. also: further columns of docs that rows keep."""
    kept = F.filter(F.coalesce(tokenise(F.col("text")), F.array().cast("array<string>")), lambda t: ~t.isin(*stop) & (F.length(t) <= p.max_token))
    listed = docs.select("id", *also, kept.alias("token"))
    length = F.size("token").cast("long").alias("length")
    if stems is None:
        return listed.select("id", *also, length, F.explode("token").alias("token")).withColumn("term", F.col("token"))
    listed = listed.withColumn("term", stems("token"))
    return listed.select("id", *also, length, F.inline(F.arrays_zip("token", "term")))


def asked_rows(docs: DataFrame, terms: DataFrame, stop: tuple[str, ...] = STOPWORDS["en"], p: Bm25 = Bm25()) -> DataFrame:
    """token_rows() of docs(id, text) whose stem is among terms(term), dealt by id. Stems are found once for each distinct token of all texts, apart from the texts, and only
    the asked tokens are dealt out."""
    rows = token_rows(docs, stop, p, stems=None).drop("term")
    each = cut(rows.select("token").distinct())  # a join's tests would be pushed below the distinct, and the stems with them
    asked = cut(each.withColumn("term", stem_of("token")).join(terms.select("term").distinct(), "term"))
    return rows.join(asked, "token").select("id", "length", "term").repartition("id")


def matches(rows: DataFrame, word_concept: DataFrame, lemmas: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """rows(id, lang, token) -> (id, lang, token, concept_id): the concept of each token, by itself, else by its lemma;
    with heads only concepts that are there, after the look-up (a hit without head doesn't fall back to the lemma)."""
    w = word_concept.withColumnRenamed("word", "token")
    if lemmas is None:
        out = rows.join(w, ["lang", "token"])
    else:
        by_lemma = lemmas.join(w.withColumnRenamed("token", "lemma"), ["lang", "lemma"]).select("lang", F.col("form").alias("token"), F.col("concept_id").alias("lemma_concept"))
        both = rows.join(w, ["lang", "token"], "left").join(by_lemma, ["lang", "token"], "left")
        out = both.withColumn("concept_id", F.coalesce("concept_id", "lemma_concept")).drop("lemma_concept").where("concept_id is not null")
    return out if heads is None else out.join(heads, "concept_id", "left_semi")


def concept_spans(docs: DataFrame, word_concept: DataFrame, prefix: str = "", allowed: DataFrame | None = None) -> DataFrame:
    """docs(id, lang, text) -> (id, concept_id, start, end): every place where a surface form of a concept stands, in characters of the prefixed text; the prefix itself never
    matches. With allowed(concept_id) only those concepts."""
    each = docs.select("id", "lang", F.explode(token_spans(F.col("text"))).alias("s"))
    rows = each.select("id", "lang", "s.token", (F.col("s.start") + len(prefix)).cast("long").alias("start"), (F.col("s.end") + len(prefix)).cast("long").alias("end"))
    return matches(rows, word_concept, heads=allowed).select("id", "concept_id", "start", "end")


def summed(x: Column, dim: int) -> Column:
    """The sum of vectors of dim places, as an aggregate."""
    return F.array(*[F.sum(x[i]) for i in range(dim)])


def focal_vectors(points: DataFrame, provider, prefix: str = "passage: ") -> DataFrame:
    """points(id, word, sentence) -> (id, x), each id once: the tokens that overlap the first place, as any substring, of the focal word in the prefixed sentence, pooled; zeros where it
    stands nowhere. A word may be found within another, or in the prefix. Tokens are pooled once for all rows that have the same."""
    at = points.select("id", F.array_join(focal_tokens(F.col("sentence"), F.col("word"), prefix), " ").alias("found")).distinct()
    at = cut(at)  # read twice
    each = at.select("found").where(F.col("found") != "").distinct().select("found", F.explode(F.split("found", " ")).alias("token"))
    x = provider.embed(each.select(F.col("token").alias("text"))).select(F.col("text").alias("token"), F.col("x").cast("array<double>").alias("x"))
    mean = each.join(x, "token").groupBy("found").agg(summed(F.col("x"), provider.dim).alias("x"), F.count(F.lit(1)).alias("n"))
    mean = mean.select("found", unit(F.transform("x", lambda v: v / F.col("n"))).alias("x"))
    return at.join(mean, "found", "left").select("id", F.coalesce("x", F.array_repeat(F.lit(0.0), provider.dim)).alias("x"))


def backbone_doc(rows: DataFrame, carve: DataFrame | None = None, p: Bm25 = Bm25()) -> DataFrame:
    """(id, term, weight): BM25 weights of the stems of the tokens outside carve(id, token); these still count in the length."""
    kept = rows if carve is None else rows.join(carve, ["id", "token"], "left_anti")
    tf = kept.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.select("id", "term", F.round(bm25(F.col("tf").cast("double"), F.col("length"), p), 6).alias("weight"))


def backbone_query(rows: DataFrame, carve: DataFrame | None = None) -> DataFrame:
    """(id, term, weight): 1 for each distinct stem of the tokens outside carve."""
    kept = rows if carve is None else rows.join(carve, ["id", "token"], "left_anti")
    return kept.select("id", "term").distinct().withColumn("weight", F.lit(1.0))


def backbone_or_concept(rows: DataFrame, word_concept: DataFrame) -> DataFrame:
    """rows(id, lang, length, token, and term if stems are known) -> (id, lang, length, term, concept_id, tf): how often each concept stands in a text, without a term, and each stem of the other tokens, without
    a concept. Tokens are counted before anything else is asked of them; the stems of concept words aren't found."""
    known = "term" in rows.columns
    n = rows.groupBy("id", "lang", "length", "token", *(["term"] if known else [])).agg(F.count(F.lit(1)).alias("n"))
    found = n.join(word_concept.withColumnRenamed("word", "token"), ["lang", "token"], "left")
    rest = F.when(F.col("concept_id").isNull(), F.col("term") if known else F.col("token"))
    found = found.withColumn("term", rest if known else stem_of(rest))
    return found.groupBy("id", "lang", "length", "term", "concept_id").agg(F.sum("n").alias("tf"))


def lexical_vectors(rows: DataFrame, word_concept: DataFrame, is_query: bool, cross_weight: float = 1.0, p: Bm25 = Bm25()) -> DataFrame:
    """rows(id, lang, length, token, and term if stems are known) -> (id, term, weight): the whole sparse vector in lexical mode. Concept words are carved out of
    the backbone ("t:" terms, times cross_weight), and their concepts ("c:" terms) weigh by their occurrences."""
    found = backbone_or_concept(rows, word_concept)
    weight = F.lit(1.0) if is_query else F.round(bm25(F.col("tf").cast("double"), F.col("length"), p), 6)
    of_word = F.col("concept_id").isNull()
    term = F.when(of_word, F.concat(F.lit("t:"), "term")).otherwise(F.concat(F.lit("c:"), "concept_id"))
    out = found.select("id", term.alias("term"), (weight * F.when(of_word, F.lit(cross_weight)).otherwise(F.lit(1.0))).alias("weight"))
    return out.distinct() if is_query else out


def encode_sparse(rows: DataFrame, word_concept: DataFrame, is_query: bool, backbone_weight: float = 1.0, learned: DataFrame | None = None, p: Bm25 = Bm25()) -> DataFrame:
    """rows(id, lang, length, token, term) -> (id, idx, value): backbone terms at their hashed indices, concepts at their own. Without learned,
    a concept has one term; with learned(id, concept_id, x, weights), pooled vectors and heads, it has the head's values times the
    weight of the words that it stands for, or 1 in queries."""
    if learned is None:
        # Both kinds of terms in one pass: their indices never meet.
        at = backbone_or_concept(rows, word_concept).withColumn("at", lexical_index(F.coalesce("term", F.lit(""))))
        of_word = F.col("concept_id").isNull()
        weight = F.lit(1.0) if is_query else F.round(bm25(F.col("tf").cast("double"), F.col("length"), p), 6)
        at = at.select("id", F.when(of_word, F.col("at")).otherwise(concept_index(F.col("concept_id"))).alias("idx"), F.coalesce("term", F.lit("")).alias("term"),
                       (weight * F.when(of_word, F.lit(backbone_weight)).otherwise(F.lit(1.0))).alias("weight"), F.when(~of_word & F.lit(not is_query), F.struct("lang", "length")).alias("own"))
        # Terms that share an index keep one weight, the largest term's: no sum.
        return at.groupBy("id", "idx", "own").agg(F.max_by("weight", "term").alias("value")).drop("own")
    v = lexical_vectors(rows, word_concept, is_query, backbone_weight, p)
    words = v.where(F.col("term").startswith("t:")).select("id", F.expr("substring(term, 3)").alias("term"), "weight").withColumn("idx", lexical_index("term"))
    # Terms that share an index keep one weight, the largest term's: no sum.
    backbone = words.groupBy("id", "idx").agg(F.max_by("weight", "term").alias("value"))
    blocks = v.where(F.col("term").startswith("c:")).select("id", F.expr("substring(term, 3)").alias("concept_id"), "weight")
    y = blocks.join(learned, ["id", "concept_id"])
    concepts = learned_blocks(y.select("id", "concept_id", "x", "weight"), learned.select("concept_id", "weights").dropDuplicates(["concept_id"]))
    return backbone.unionByName(concepts)


def concept_index(concept_id: Column) -> Column:
    """The first of a concept's eight places among the indices."""
    return F.substring(concept_id, 3, 20).cast("long") * 8


def lexical_blocks(found: DataFrame, lengths: DataFrame | None, p: Bm25 = Bm25()) -> DataFrame:
    """found(id, concept_id) -> (id, idx, weight): one term a concept, 1 for queries (no lengths), BM25 of its occurrences for documents."""
    n = found.groupBy("id", "concept_id").agg(F.count(F.lit(1)).alias("tf"))
    if lengths is None:
        weight = F.lit(1.0)
    else:
        n, weight = n.join(lengths, "id"), F.round(bm25(F.col("tf").cast("double"), F.col("length"), p), 6)
    return n.select("id", concept_index(F.col("concept_id")).alias("idx"), weight.alias("weight"))


def learned_blocks(vectors: DataFrame, heads: DataFrame) -> DataFrame:
    """vectors(id, concept_id, x, weight) and heads(concept_id, weights) -> (id, idx, value): tanh of the head, to unit length,
    times the weight; values within epsilon of 0 are left out."""
    y = vectors.join(heads, "concept_id").withColumn("y", head(F.col("weights"), F.col("x")))
    scaled = F.transform("y", lambda v: v / F.greatest(norm(F.col("y")), F.lit(1e-6)) * F.col("weight"))
    each = y.select("id", "concept_id", F.posexplode(scaled).alias("pos", "value"))
    return each.where(F.abs("value") > EPSILON).select("id", (concept_index(F.col("concept_id")) + F.col("pos")).alias("idx"), F.round("value", 6).alias("value"))


def packed(postings: DataFrame) -> DataFrame:
    """postings(id, idx, weight) -> (id, indices, values), sorted by index, in 32-bit floats."""
    p = postings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("weight").cast("float").alias("weight")))).alias("p"))
    return p.select("id", F.col("p")["idx"].alias("indices"), F.col("p")["weight"].alias("values"))


def sentence_vectors(points: DataFrame, provider, prefix: str = "passage: ") -> DataFrame:
    """points(id, lang, sentence) -> (id, lang, x): each sentence, with the prefix, is embedded once, and all rows that hold it share the vector."""
    texts = points.select(F.concat(F.lit(prefix), "sentence").alias("text"))
    return points.withColumn("text", F.concat(F.lit(prefix), "sentence")).join(provider.embed(texts), "text").select("id", "lang", "x")


def pooling_of(mode: str, pooling: str) -> str:
    """The pooling of an embedding mode: a remote service embeds whole sentences only."""
    if mode not in ("local", "remote") or pooling not in ("sentence", "token"):
        raise ValueError(f"unknown mode or pooling: {mode}, {pooling}")
    if mode == "remote" and pooling != "sentence":
        raise ValueError("a remote service gives sentence vectors only")
    return pooling


def own_token_vectors(texts: DataFrame, word_concept: DataFrame, provider, wanted: DataFrame | None = None) -> DataFrame:
    """texts(id, lang, text) -> (id, concept_id, n_spans, x): for each concept whose surface forms stand in the text, the mean of the vectors of all their
    occurrences, to unit length. With wanted(id, concept_id), only those. What a text and concept need is the count of each form: counts go to
    the concept, whose few forms have their vectors there, so that no vector is dealt out with a text."""
    found = matches(texts.select("id", "lang", F.explode(tokens(F.col("text"))).alias("token")), word_concept).select("id", "concept_id", "token").repartition("id", "concept_id")
    if wanted is not None:
        found = found.join(wanted, ["id", "concept_id"], "left_semi")
    n = found.groupBy("id", "concept_id", "token").agg(F.count(F.lit(1)).alias("n"))
    own = n.groupBy("id", "concept_id").agg(F.sum("n").alias("n_spans"), F.collect_list(F.struct("token", "n")).alias("own"))
    x = provider.embed(word_concept.select(F.col("word").alias("text"))).select(F.col("text").alias("word"), unit(F.col("x")).alias("x"))
    forms = word_concept.select("concept_id", "word").distinct().join(x, "word").groupBy("concept_id").agg(F.collect_list(F.struct("word", "x")).alias("forms"))
    of = lambda h: F.filter("forms", lambda f: f["word"] == h["token"])[0]["x"]
    zeros = F.array_repeat(F.lit(0.0), provider.dim)
    total = F.aggregate("own", zeros, lambda s, h: F.zip_with(s, of(h), lambda a, v: a + v * h["n"]))
    one = F.size("own") == 1
    return own.join(forms, "concept_id").select("id", "concept_id", "n_spans", F.when(one, of(F.col("own")[0])).otherwise(unit(total)).alias("x"))


def concept_vectors(docs: DataFrame, word_concept: DataFrame, provider, heads: DataFrame | None = None) -> DataFrame:
    """docs(id, lang, text) -> (id, concept_id, x): the vectors of the tokens that stand for a concept, each occurrence pooled, then all; an occurrence is one token, so that counts of tokens
    say all. With heads only their concepts; those of surface forms alone, as training inputs have to be."""
    known = word_concept if heads is None else word_concept.join(heads.select("concept_id"), "concept_id", "left_semi")
    return own_token_vectors(docs, known, provider).select("id", "concept_id", "x")
