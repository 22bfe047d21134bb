"""Bilingual concept vocabulary: dictionaries, translation graph, numbering, pruning, subsets, demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, valid_entry
from .order import numbered, running


BUCKETS = 64


def ranked_words(arts: DataFrame) -> DataFrame:
    """(lang, word, bucket, i): all valid words, by hash in buckets, and in each from 0 by falling number of documents, ties by word."""
    per_doc = arts.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    n = per_doc.where(valid_entry(F.col("word"))).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    n = n.withColumn("bucket", F.conv(F.substring(F.sha1("word"), 1, 2), 16, 10).cast("long") % BUCKETS)
    i = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("df"), "word"))
    return n.withColumn("i", (i - 1).cast("long")).select("lang", "word", "bucket", "i")


def pseudo_dictionary(arts: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(dir, ord, src, tgt): a deterministic stand-in for translation dictionaries, which pairs all words of equal bucket and rank that both
    languages have; every third English word has a second translation, the next Spanish word. ranked: ranked_words() of arts, if they are kept, as each language reads them."""
    r = ranked_words(arts) if ranked is None else ranked
    en, es = (r.where(F.col("lang") == x).select(F.col("word").alias(x), "bucket", "i") for x in ("en", "es"))
    same = en.join(es, ["bucket", "i"])
    second = en.where("i % 3 = 0").join(es.withColumn("i", F.col("i") - 1), ["bucket", "i"])
    at = lambda k: ((F.col("i") * BUCKETS + F.col("bucket")) * 2 + k).alias("ord")
    return (
        same.select(F.lit("en-es").alias("dir"), at(1), F.col("en").alias("src"), F.col("es").alias("tgt"))
        .unionAll(second.select(F.lit("en-es").alias("dir"), at(2), F.col("en").alias("src"), F.col("es").alias("tgt")))
        .unionAll(same.select(F.lit("es-en").alias("dir"), at(1), F.col("es").alias("src"), F.col("en").alias("tgt")))
    )


def linked_dictionary(arts: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(dir, ord, src, tgt): a second stand-in, whose graph hangs together. Words of a bucket go in pairs of ranks, each of which has the two words of the other language's pair as
    translations, its own rank first; every third English word's second translation is of the next bucket instead, at a quarter of the
    rank. So synonyms form small dense groups, and frequent words of many senses tie groups of all buckets together. ranked: as in pseudo_dictionary()."""
    r = ranked_words(arts) if ranked is None else ranked
    en, es = (r.where(F.col("lang") == x).select(F.col("word").alias(x), "bucket", "i") for x in ("en", "es"))
    near = F.col("i").bitwiseXOR(F.lit(1).cast("long")).alias("i")
    afar = en.where("i % 3 = 0").select("en", (F.col("bucket") + 1) % BUCKETS, F.floor(F.col("i") / F.lit(4.0)), (F.col("i") * BUCKETS + F.col("bucket")).alias("at")).toDF("en", "bucket", "i", "at")
    at = (F.col("i") * BUCKETS + F.col("bucket")).alias("at")
    keyed = lambda w, df: df.select(w, "bucket", "i", at)
    row = lambda df, d, a, b, k: df.select(F.lit(d).alias("dir"), (F.col("at") * 2 + k).alias("ord"), F.col(a).alias("src"), F.col(b).alias("tgt"))
    twin = lambda w, df: df.select(w, "bucket", near, at)
    first = row(keyed("en", en).join(es, ["bucket", "i"]), "en-es", "en", "es", 1)
    second = row(twin("en", en.where("i % 3 <> 0")).join(es, ["bucket", "i"]), "en-es", "en", "es", 2)
    third = row(afar.join(es, ["bucket", "i"]), "en-es", "en", "es", 2)
    back = row(keyed("es", es).join(en, ["bucket", "i"]), "es-en", "es", "en", 1)
    back2 = row(twin("es", es).join(en, ["bucket", "i"]), "es-en", "es", "en", 2)
    return first.unionAll(second).unionAll(third).unionAll(back).unionAll(back2)


def top_translations(pairs: DataFrame, k: int = 2) -> DataFrame:
    """The first k valid pairs of each source word by file order."""
    ok = pairs.where(valid_entry(F.col("src")) & valid_entry(F.col("tgt")))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("dir", "src").orderBy("ord")).cast("long")).where(F.col("rank") <= k)


def edges(top: DataFrame) -> DataFrame:
    """(u, v, weight): undirected edges between language-marked words, weighted by the directed pairs on them."""
    forward = F.col("dir") == "en-es"
    en, es = F.when(forward, F.col("src")).otherwise(F.col("tgt")), F.when(forward, F.col("tgt")).otherwise(F.col("src"))
    return top.select(F.concat(F.lit("en:"), en).alias("u"), F.concat(F.lit("es:"), es).alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight"))


def clusters(parts: DataFrame) -> DataFrame:
    """parts(node, component) -> (component, en, es): sorted words by language. Parts are to be of bounded size, as those of louvain_parts are."""
    lang, word = F.substring("node", 1, 2), F.expr("substring(node, 4)")
    own = lambda x: F.array_sort(F.collect_set(F.when(lang == x, word)))
    return parts.groupBy("component").agg(own("en").alias("en"), own("es").alias("es"))


def concepts(found: DataFrame, min_size: int = 2) -> DataFrame:
    """(concept_id, en, es, size) of the clusters with both languages and enough words, numbered by falling size, then by their first English word."""
    size = (F.size("en") + F.size("es")).cast("long")
    kept = found.where((F.size("en") > 0) & (F.size("es") > 0)).withColumn("size", size).where(F.col("size") >= min_size)
    n = numbered(kept.withColumn("first", F.col("en")[0]), [F.desc("size"), F.col("first")])
    return n.select(F.format_string("C-%05d", F.col("n") - 1).alias("concept_id"), "en", "es", "size")


def filter_report(found: DataFrame, min_size: int = 2) -> DataFrame:
    """How many clusters are monolingual, too small (of the others), and kept."""
    mono = (F.size("en") == 0) | (F.size("es") == 0)
    small = ~mono & (F.size("en") + F.size("es") < min_size)
    return found.agg(F.count_if(mono).alias("monolingual"), F.count_if(small).alias("undersized"), F.count_if(~mono & ~small).alias("kept"))


def word_concepts(vocab: DataFrame) -> DataFrame:
    """(lang, word, concept_id)."""
    each = lambda x: vocab.select(F.lit(x).alias("lang"), F.explode(x).alias("word"), "concept_id")
    return each("en").unionAll(each("es"))


def size_stats(vocab: DataFrame) -> DataFrame:
    """Least, largest, mean (2 places) and nearest-rank median, 90th and 99th percentile of the sizes."""
    g = vocab.groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    g = g.withColumns({"upto": F.sum("k").over(Window.orderBy("size")), "all": F.sum("k").over(Window.partitionBy())})
    at = lambda pos: F.min(F.when(F.col("upto") > pos, F.col("size")))
    return g.agg(
        F.min("size").alias("min"), F.max("size").alias("max"), F.round(F.sum(F.col("size") * F.col("k")) / F.sum("k").cast("double"), 2).alias("mean"),
        at(F.floor(F.col("all") / F.lit(2.0))).alias("median"), at(F.floor(F.col("all") * F.lit(0.9))).alias("p90"), at(F.floor(F.col("all") * F.lit(0.99))).alias("p99"),
    )


def supply(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """(concept_id, en, es, en_n, es_n): counts in both languages, 0 where there are none."""
    n = lambda x: counts.where(F.col("lang") == x).select("concept_id", F.col("n").alias(f"{x}_n"))
    both = vocab.join(n("en"), "concept_id", "left").join(n("es"), "concept_id", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("en_n", "es_n")})


def prune(vocab: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """The concepts with threshold sentences or more in both languages, renumbered by (falling size, old id)."""
    ok = supply(vocab, counts).where(F.least("en_n", "es_n") >= threshold)
    n = numbered(ok, [F.desc("size"), F.col("concept_id")])
    return n.select(F.format_string("C-%05d", F.col("n") - 1).alias("concept_id"), F.col("concept_id").alias("old_id"), "en", "es", "size")


def prune_stats(vocab: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: concepts and words of a vocabulary, those kept, and the shares kept in per cent to one place."""
    marked = vocab.select("concept_id", "size").join(kept.select(F.col("old_id").alias("concept_id"), F.lit(True).alias("ok")), "concept_id", "left")
    n = lambda x, c: [F.count_if(c).alias(f"concepts{x}"), F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long").alias(f"words{x}")]
    j = marked.agg(*n("", F.lit(True)), *n("_kept", F.coalesce("ok", F.lit(False))))
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(F.lit(100.0) * F.col(a) / F.col(b), 1))
    return j.withColumns({"kept_pct": pct("concepts_kept", "concepts"), "words_pct": pct("words_kept", "words")})


def select_ids(vocab: DataFrame, word_concept: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, their look-up, those of them without any word in it): a vocabulary cut to ids, which stay as they are."""
    some = vocab.join(ids.select("concept_id").distinct(), "concept_id", "left_semi")
    words = word_concept.join(some.select("concept_id"), "concept_id", "left_semi")
    return some, words, some.select("concept_id").join(words, "concept_id", "left_anti")


def subset(vocab: DataFrame, ids: DataFrame) -> DataFrame:
    """The given concepts with their ids; raises for ids that aren't there (naming five)."""
    if missing := [r[0] for r in ids.join(vocab, "concept_id", "left_anti").orderBy("concept_id").limit(5).collect()]:
        raise ValueError(f"unknown concepts: {missing}")
    return vocab.join(ids, "concept_id", "left_semi")


def pool(query_id: Column) -> Column:
    """select or holdout, by the SHA-1 of the id modulo 5: as 16 is 1 modulo 5, that is the sum of its hex digits."""
    digits = F.transform(F.split(F.sha1(query_id.cast("string")), ""), lambda c: F.conv(c, 16, 10).cast("long"))
    total = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda a, d: a + d)
    return F.when(total % 5 != 0, F.lit("select")).otherwise(F.lit("holdout"))


def demand(matches: DataFrame) -> DataFrame:
    """matches(pool, concept_id) -> (concept_id, demand): occurrences in the select pool."""
    return matches.where("pool = 'select'").groupBy("concept_id").agg(F.count(F.lit(1)).alias("demand"))


def demand_marks(need: DataFrame, marks: tuple[float, ...] = (0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """For each mark: how many concepts, most wanted first, reach that share of the demand."""
    run = running(need, [F.desc("demand"), F.col("concept_id")], "demand")
    each = run.withColumn("mark", F.explode(F.array(*[F.lit(float(m)) for m in marks])))
    return each.where(F.col("cum") >= F.col("mark") * F.col("total")).groupBy("mark").agg(F.min("n").alias("concepts"))


def demand_ceiling(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """tokens(pool) and matches(pool, concept_id) -> by pool: tokens, those that match a concept, and their share."""
    n = tokens.groupBy("pool").agg(F.count(F.lit(1)).alias("tokens"))
    m = matches.groupBy("pool").agg(F.count(F.lit(1)).alias("matched"))
    j = n.join(m, "pool", "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))
    return j.withColumn("ceiling", F.round(F.col("matched") / F.col("tokens").cast("double"), 6))


def demand_choice(need: DataFrame, mark: float) -> DataFrame:
    """(concept_id, demand, place): the most wanted concepts up to the first that brings the share of the demand to mark."""
    run = running(need, [F.desc("demand"), F.col("concept_id")], "demand").withColumnRenamed("n", "place")
    return run.where(F.col("cum") - F.col("demand") < F.lit(mark) * F.col("total")).select("concept_id", "demand", "place")


def chosen(vocab: DataFrame, spec: str, trained: DataFrame | None = None) -> DataFrame:
    """Concepts by "a:b" (numbers from a up to, not including, b) or a comma list of numbers or ids, less those that are trained."""
    number = F.substring("concept_id", 3, 20).cast("long")
    if ":" in spec:
        low, high = spec.split(":")
        out = vocab.where((number >= int(low or 0)) & (number < int(high) if high else F.lit(True)))
    else:
        wanted = [int(x.removeprefix("C-")) for x in spec.split(",")]
        out = vocab.where(number.isin(wanted))
    return out if trained is None else out.join(trained, "concept_id", "left_anti")


def best_supplied(supplied: DataFrame, least: int, most: int) -> DataFrame:
    """The most concepts with the largest smaller count of the two languages, of those with least or more."""
    m = supplied.withColumn("supplied", F.least("en_n", "es_n")).where(F.col("supplied") >= least)
    return m.orderBy(F.desc("supplied"), "concept_id").limit(most).select("concept_id", "supplied")


def content_concepts(vocab: DataFrame, stop: tuple[str, ...], least_chars: int = 4) -> DataFrame:
    """Concepts with a word, of either language, of least_chars or more outside the stop list."""
    ok = lambda w: (F.length(w) >= least_chars) & ~w.isin(*stop)
    return vocab.where(F.exists("en", ok) | F.exists("es", ok))


def attach_orphans(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, component): words without a part that join the one of their first translation (of equal spelling doesn't count), English words first, then Spanish
    ones, for which the English just attached count as placed. A translation without a part opens one, which bears its name and which all words of the pass that
    have it first share. So no word waits for another of its own pass, and each pass is a join."""
    ok = pairs.where(valid_entry(F.col("src")) & valid_entry(F.col("tgt")) & (F.col("src") != F.col("tgt")))
    first = ok.groupBy("dir", "src").agg(F.min_by("tgt", "ord").alias("tgt"))
    out = None
    for direction, own, other in (("en-es", "en:", "es:"), ("es-en", "es:", "en:")):
        placed = parts.select("node", "component") if out is None else parts.select("node", "component").unionByName(out)
        orphans = first.where(F.col("dir") == direction).select(F.concat(F.lit(own), "src").alias("node"), F.concat(F.lit(other), "tgt").alias("to")).join(placed, "node", "left_anti")
        joined = orphans.join(placed.withColumnRenamed("node", "to"), "to", "left")
        opened = joined.where("component IS NULL").select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
        got = joined.select("node", F.coalesce("component", "to").alias("component")).unionByName(opened)
        out = got if out is None else out.unionByName(got)
    return out
