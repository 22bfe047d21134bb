"""Sampling of stored rows: caps, ids, upserts, balance, order, splits, trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import row_uuid, sentences, shortened, trim_around, words
from .graph import cut


def capped(hits: DataFrame, per_article: int = 2, per_concept: int = 100) -> DataFrame:
    """At most per_article rows of a concept from an article, then at most per_concept of a concept and language, in
    article and sentence order, words by alphabet."""
    a = Window.partitionBy("lang", "doc_id", "concept_id").orderBy("sent_ord", "word")
    c = Window.partitionBy("lang", "concept_id").orderBy("doc_id", "sent_ord", "word")
    kept = hits.withColumn("ra", F.row_number().over(a)).where(F.col("ra") <= per_article)
    return kept.withColumn("rank", F.row_number().over(c).cast("long")).where(F.col("rank") <= per_concept).drop("ra")


def word_places(arts: DataFrame, low: int = 5, high: int = 100, min_chars: int = 50) -> DataFrame:
    """arts(lang, doc_id, text) -> (lang, doc_id, text_key, sent_ord, word): the distinct words of the sentences that corpus.sized() lets through, without the sentences."""
    own = arts.where(F.length("text") >= min_chars).select("lang", "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(sentences(F.col("text"))).alias("sent_ord", "sentence"))
    found = own.select("lang", "doc_id", "text_key", F.col("sent_ord").cast("long").alias("sent_ord"), words(F.col("sentence")).alias("words"))
    # The test goes inside a generator, as in corpus.sized().
    fits = found.select("lang", "doc_id", "text_key", "sent_ord", F.explode(F.when(F.size("words").between(low, high), F.array("words"))).alias("words"))
    return fits.select("lang", "doc_id", "text_key", "sent_ord", F.explode("words").alias("word"))


def capped_places(places: DataFrame, word_concept: DataFrame, per_article: int = 2, per_concept: int = 100) -> DataFrame:
    """capped() of the places of words with their concepts. Before words meet concepts, only a word's first per_concept articles are left, in each task and then of all: each gives
    its concept a row at least, so later ones would come after the concept's cap. From then on no word or concept has many rows."""
    n = F.dense_rank().over(Window.partitionBy("lang", "word").orderBy("doc_id"))
    few = places.withColumn("n", n).where(F.col("n") <= per_concept).drop("n")
    # Dealt by concept once, which serves both caps.
    return capped(few.join(word_concept, ["lang", "word"]).repartition("lang", "concept_id"), per_article, per_concept)


def with_sentences(places: DataFrame, arts: DataFrame) -> DataFrame:
    """places(lang, doc_id, text_key, sent_ord, ...) with their sentences, which each article is split into once. Ids may repeat or be null: an article is known by its text, too."""
    rest = [c for c in places.columns if c not in ("lang", "doc_id", "text_key")]
    key = ["lang", "own_id", "text_key"]
    own = F.coalesce("doc_id", F.lit(0).cast("long")).alias("own_id")
    of = places.select("lang", own, F.xxhash64("doc_id", "text_key").alias("text_key"), F.struct("doc_id", *rest).alias("at")).groupBy(*key).agg(F.collect_list("at").alias("at"))
    texts = arts.select("lang", own, F.xxhash64("doc_id", F.xxhash64("text")).alias("text_key"), "text")
    each = of.join(texts, key).dropDuplicates(key).select("lang", "at", F.explode(F.array(sentences(F.col("text")))).alias("s"))
    each = each.select("lang", F.inline(F.transform("at", lambda h: F.struct(*[h[c].alias(c) for c in ("doc_id", *rest)], F.get("s", h["sent_ord"].cast("int")).alias("sentence")))))
    return each.select("lang", "doc_id", *rest, "sentence")


def capped_articles(arts: DataFrame, word_concept: DataFrame, per_article: int = 2, per_concept: int = 100) -> DataFrame:
    """capped() of all hits of arts(lang, doc_id, text), with a rank in its concept and language. Only words and places are dealt out; chosen rows get their sentences at the end."""
    return with_sentences(capped_places(word_places(arts), word_concept, per_article, per_concept), arts)


def points(rows: DataFrame) -> DataFrame:
    """With the point id of (lang, word, sentence)."""
    return rows.withColumn("id", row_uuid(F.col("lang"), F.col("word"), F.col("sentence")))


def latest(rows: DataFrame, order: Column) -> DataFrame:
    """The last written row of each id."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(order.desc()))).where("rn = 1").drop("rn")


def scroll(points: DataFrame, max_per_lang: int, ratio: float | None = None) -> DataFrame:
    """At most max_per_lang rows of each concept and language, by id; with a ratio the languages are then brought to it."""
    n = F.row_number().over(Window.partitionBy("concept_id", "lang").orderBy("id"))
    rows = points.withColumn("rn", n).where(F.col("rn") <= max_per_lang).drop("rn")
    return rows if ratio is None else balance(rows, ratio, F.col("id"))


def balance(rows: DataFrame, ratio: float, key: Column) -> DataFrame:
    """rows(concept_id, lang, ...) with each concept's languages brought to ratio (English share): only the side above its
    target is cut, in the order of key, and only where both languages have rows."""
    w = Window.partitionBy("concept_id")
    n = rows.withColumns({"n_en": F.count_if(F.col("lang") == "en").over(w), "n_es": F.count_if(F.col("lang") == "es").over(w), "rn": F.row_number().over(Window.partitionBy("concept_id", "lang").orderBy(key))})
    total = F.col("n_en") + F.col("n_es")
    en = F.floor(total * F.lit(ratio))
    both = (F.col("n_en") > 0) & (F.col("n_es") > 0) & F.lit(0 < ratio < 1)
    target = F.when(~both, total).when(F.col("lang") == "en", F.greatest(en, F.lit(0))).otherwise(total - en)
    return n.where(F.col("rn") <= target).drop("n_en", "n_es", "rn")


def interleave(rows: DataFrame, order: Column) -> DataFrame:
    """With pos: English and Spanish rows of a concept in turn, then what is left of the longer side."""
    w = Window.partitionBy("concept_id")
    n = rows.withColumns({"rn": F.row_number().over(Window.partitionBy("concept_id", "lang").orderBy(order)), "both": F.least(F.count_if(F.col("lang") == "en").over(w), F.count_if(F.col("lang") == "es").over(w))})
    at = F.row_number().over(w.orderBy((F.col("rn") > F.col("both")), "rn", "lang"))
    return n.withColumn("pos", at.cast("long")).drop("rn", "both")


def tail_split(rows: DataFrame) -> DataFrame:
    """With part: the last fifth of a concept's rows (one at least, three stay) is for validation, if it has more than 3."""
    w = Window.partitionBy("concept_id")
    n = F.count(F.lit(1)).over(w)
    n_val = F.when(n > 3, F.least(F.greatest(F.floor(n * F.lit(0.2)), F.lit(1)), n - 3)).otherwise(F.lit(0))
    return rows.withColumn("part", F.when(F.col("pos") > n - n_val, "validation").otherwise("train"))


def trims(rows: DataFrame, window: int = 5) -> DataFrame:
    """Trimmed copies of the sentences that a window around the first target word shortens."""
    return rows.select("*", F.explode(shortened(F.col("sentence"), F.array("word"), window)).alias("trimmed"))


def buckets(points: DataFrame, most: int) -> DataFrame:
    """points(concept_id, lang, id) -> (concept_id, lang, ids): the first most distinct ids of each concept and language."""
    one = points.select("concept_id", "lang", "id").distinct()
    n = F.row_number().over(Window.partitionBy("concept_id", "lang").orderBy("id"))
    kept = one.withColumn("n", n).where(F.col("n") <= most)
    return kept.groupBy("concept_id", "lang").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def lookup(points: DataFrame, lists: DataFrame) -> DataFrame:
    """Stored rows by lists(concept_id, lang, ids), which no longer know their focal word: it is empty."""
    wanted = lists.select("concept_id", "lang", F.explode("ids").alias("id"))
    return points.dropDuplicates(["id", "lang", "concept_id"]).join(wanted, ["concept_id", "lang", "id"], "left_semi").withColumn("focal", F.lit(""))


def located(rows: DataFrame) -> DataFrame:
    """Rows whose word is found among the sentence's words, each concept's numbered from 0 without a gap."""
    found = rows.withColumn("around", trim_around(F.col("sentence"), F.array("word"))).where("around IS NOT NULL").drop("around")
    return found.withColumn("idx", F.row_number().over(Window.partitionBy("concept_id").orderBy("id", "rank")).cast("long") - 1)


def trainable(before: DataFrame, after: DataFrame, least: int) -> DataFrame:
    """(concept_id, n_before, n_after) of concepts with least rows or more both before and after preparation."""
    n = lambda df, x: df.groupBy("concept_id").agg(F.count(F.lit(1)).alias(x)).where(F.col(x) >= least)
    return n(before, "n_before").join(n(after, "n_after"), "concept_id")


def teacher_copies(made: DataFrame, rows: DataFrame) -> DataFrame:
    """made(id, source) with concept, language and vector of the rows(id, ...) they were made from."""
    return made.join(rows.withColumnRenamed("id", "source"), "source")


def coupled(hits: DataFrame, per_concept: int, per_word: int | None = None, docs: DataFrame | None = None, first: int = 1000, growth: int = 8, often: int = 10_000) -> DataFrame:
    """hits(lang, doc_id, sent_ord, word, concept_id) -> at most a row a sentence, in order of document, sentence and language: its first word whose concept and
    which itself has had fewer rows than its cap. A word of a language is of one concept.

    Documents come in blocks in the order of their ids, of about first documents and then growth times as many as before (docs(doc_id) saves counting them in hits): what earlier
    blocks keep stays, whatever comes later. So words that the first blocks fill are left out of later ones; the often most frequent of these before anything is dealt out, which leaves rare words."""
    docs = hits if docs is None else docs
    ends, n, at = [], docs.count(), first
    while at < n:
        ends.append(at / n)
        at += at * growth
    edges = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, ends)))).first()[0] or [] if ends else []
    edges = sorted(set(edges))
    kept = shut = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        inside = inside if high is None else inside & (F.col("doc_id") <= high) | (F.col("doc_id").isNull() & F.lit(low is None))
        part = hits.where(inside).select("lang", "doc_id", "sent_ord", "word", "concept_id")
        if kept is not None:
            part = part.join(F.broadcast(shut), ["lang", "word"], "left_anti")
            for by, full in closed:
                part = part.join(full, by, "left_anti")
        rows = part.select(F.struct("doc_id", "sent_ord", "lang").alias("at"), "word", "concept_id").distinct()
        rows = cut(rows if kept is None else rows.unionByName(kept))
        n_rows = cut(rows.groupBy(F.col("at.lang").alias("lang"), "word", "concept_id").agg(F.count(F.lit(1)).alias("n")))
        kept = _settled(rows, per_concept, per_word)
        if high is not None:
            closed = [(by, kept.withColumn("lang", F.col("at.lang")).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).drop("n")) for by, cap in _doors(per_concept, per_word)]
            gone = None
            for by, full in closed:
                g = n_rows.join(full, by, "left_semi")
                gone = g if gone is None else gone.unionByName(g)
            top = gone.distinct().orderBy(F.desc("n"), "lang", "word").limit(often).select("lang", "word")
            shut = cut(top if shut is None else shut.unionByName(top))
    return kept.select("at.lang", "at.doc_id", "at.sent_ord", "word", "concept_id")


def _doors(per_concept: int, per_word: int | None) -> list[tuple[list[str], int]]:
    return [(by, cap) for by, cap in ((["lang", "word"], per_word), (["concept_id"], per_concept)) if cap is not None]


def _settled(rows: DataFrame, per_concept: int, per_word: int | None) -> DataFrame:
    """rows(at, word, concept_id) -> those that coupled() keeps.

    Each row depends on all before it, but not one after the other: every sentence asks for its first word that may still be open; each word, and then each
    concept, keeps the earliest that ask, up to its cap; once full, it is closed to all later sentences than its last, and these ask for their next
    word. When nobody is turned away, what is kept is what the loop over all rows would keep: a word or concept that is full only ever changes a
    later sentence for an earlier one, so that a closed door never opens again. Rows behind closed doors go for good, so that rounds get smaller. rows is a cut, and removed."""
    before = None
    while True:
        asked = rows.groupBy("at").agg(F.min(F.struct("word", "concept_id")).alias("w")).select("at", F.col("at.lang").alias("lang"), "w.*")
        ok = F.lit(True)
        doors = _doors(per_concept, per_word)
        for i, (by, cap) in enumerate(doors):
            asked = asked.withColumn(f"n{i}", F.count_if(ok).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            asked = asked.withColumn(f"full{i}", ok & (F.col(f"n{i}") == cap))
            ok = ok & (F.col(f"n{i}") <= cap)
        asked = before = cut(asked.withColumn("ok", ok), gone=before)
        if asked.where(~F.col("ok")).isEmpty():
            return asked.select("at", "word", "concept_id")
        for i, (by, _) in enumerate(doors):
            last = asked.where(f"full{i}").select(*by, F.col("at").alias("last"))
            rows = rows.withColumn("lang", F.col("at.lang")).join(last, by, "left").where(F.col("last").isNull() | (F.col("at") <= F.col("last"))).select("at", "word", "concept_id")
        rows = cut(rows, gone=rows)


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and how many of them pass by, which is known once they are written."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
