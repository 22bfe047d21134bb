"""The tables and derived relations that queries start from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, encode, graph, sample, search, vectors, vocab
from ..sources.store import listing

_kept: dict[tuple[str, ...], DataFrame] = {}


def forget() -> None:
    """Lets go of all that is kept."""
    _kept.clear()


class Base:
    """Relations over one data folder. Components, communities and concepts are found once a session and state of the folder's files, as they run jobs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def files(self) -> str:
        return listing(self.spark, f"{self.dir}/documents.parquet")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def arts(self) -> DataFrame:
        return corpus.articles(self.docs)

    @cached_property
    def sents(self) -> DataFrame:
        return corpus.sentence_rows(self.arts)

    @cached_property
    def good(self) -> DataFrame:
        return corpus.sized(corpus.sentence_rows(self.arts.where(F.length("text") >= 50)))

    @cached_property
    def ranked(self) -> DataFrame:
        """The ranked words, which dictionaries read for each language and direction: texts are tokenised for them once."""
        return self.kept("ranked words", lambda: graph.cut(vocab.ranked_words(self.arts)))

    @cached_property
    def dictionary(self) -> DataFrame:
        return vocab.pseudo_dictionary(self.arts, self.ranked)

    @cached_property
    def top(self) -> DataFrame:
        return vocab.top_translations(self.dictionary)

    @cached_property
    def edges(self) -> DataFrame:
        return self.kept("edges", lambda: graph.cut(vocab.edges(self.top)))

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, made once for these very files: a folder that is written again has others, by name, size or time."""
        key = (self.spark.sparkContext.applicationId, self.dir, self.files, name)
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]

    @cached_property
    def whole(self) -> DataFrame:
        """The connected components of the translation graph."""
        return self.kept("components", lambda: graph.components(self.edges))

    @cached_property
    def communities(self) -> DataFrame:
        return self.kept("communities", lambda: graph.cut(graph.louvain_parts(self.edges, self.whole)))

    @cached_property
    def parts(self) -> DataFrame:
        """The communities as a partition (node, component), which concepts are made of."""
        return self.communities.select("node", F.col("part").alias("component"))

    @cached_property
    def linked_edges(self) -> DataFrame:
        """The translation graph of the second stand-in, which hangs together."""
        return self.kept("linked edges", lambda: graph.cut(vocab.edges(vocab.top_translations(vocab.linked_dictionary(self.arts, self.ranked)))))

    @cached_property
    def linked_whole(self) -> DataFrame:
        return self.kept("linked components", lambda: graph.components(self.linked_edges))

    @cached_property
    def linked_communities(self) -> DataFrame:
        return self.kept("linked communities", lambda: graph.cut(graph.louvain_parts(self.linked_edges, self.linked_whole)))

    @cached_property
    def clusters(self) -> DataFrame:
        return vocab.clusters(self.parts)

    @cached_property
    def vocab(self) -> DataFrame:
        return self.kept("concepts", lambda: graph.cut(vocab.concepts(self.clusters)))

    @cached_property
    def word_concept(self) -> DataFrame:
        return vocab.word_concepts(self.vocab)

    @cached_property
    def hits(self) -> DataFrame:
        return corpus.concept_hits(self.good, self.word_concept)

    @cached_property
    def counts(self) -> DataFrame:
        return corpus.concept_counts(self.good, self.word_concept)

    @cached_property
    def capped(self) -> DataFrame:
        return sample.capped_articles(self.arts, self.word_concept)

    @cached_property
    def points(self) -> DataFrame:
        return sample.points(self.capped)

    @cached_property
    def latest(self) -> DataFrame:
        return sample.latest(self.points, F.col("doc_id") * 1_000_000 + F.col("sent_ord")).select("id", "lang", "concept_id", "word", "doc_id", "sent_ord")

    @cached_property
    def stored(self) -> DataFrame:
        """What a collection holds: the last written row of each id, with its sentence. Written once, as all that starts from it reads it several times."""
        return self.kept("stored rows", lambda: graph.cut(self.stored_of(self.word_concept)))

    def stored_of(self, word_concept: DataFrame) -> DataFrame:
        """The stored rows of some concepts. Caps are a concept's own, and a word of a language is of one concept, so that no other concept's words have to be looked at."""
        points = sample.points(sample.capped_articles(self.arts, word_concept))
        return sample.latest(points, F.col("doc_id") * 1_000_000 + F.col("sent_ord")).select("id", "lang", "concept_id", "word", "sentence")

    @cached_property
    def balanced(self) -> DataFrame:
        return sample.balance(self.latest, 0.5, F.col("id")).select("id", "lang", "concept_id")

    @cached_property
    def ordered(self) -> DataFrame:
        return sample.interleave(self.balanced, F.col("id")).select("id", "lang", "concept_id", "pos")

    @cached_property
    def doc_tokens(self) -> DataFrame:
        return encode.token_rows(self.docs.select(F.col("doc_id").alias("id"), "text"))

    @cached_property
    def lang_tokens(self) -> DataFrame:
        """The tokens of documents, which are dealt by id before they are cut into tokens, with their languages and without stems."""
        docs = self.docs.select(F.col("doc_id").alias("id"), "lang", "text").repartition("id")
        return encode.token_rows(docs, stems=None, also=("lang",)).drop("term")

    @cached_property
    def query_tokens(self) -> DataFrame:
        return encode.token_rows(self.table("benchmark").select(F.col("item_id").alias("id"), "text"))

    @cached_property
    def query_terms(self) -> DataFrame:
        return graph.cut(encode.backbone_query(self.query_tokens).select(F.col("id").alias("qid"), "term", F.col("weight").alias("q")))

    def ranked_docs(self, k: int = 10) -> DataFrame:
        postings = encode.backbone_doc(encode.asked_rows(self.docs.select(F.col("doc_id").alias("id"), "text"), self.query_terms)).withColumnRenamed("weight", "d")
        return search.search(self.query_terms, postings, self.docs.count(), k)

    @cached_property
    def first_hundred(self) -> DataFrame:
        """The first hundred of each query, ranked once for all that reads them."""
        return graph.cut(self.ranked_docs(100))

    @cached_property
    def translations(self) -> DataFrame:
        """(src, tgt): the first Spanish translation of each English word."""
        return self.translations_of("en-es")

    def translations_of(self, direction: str) -> DataFrame:
        """(src, tgt): the first translation of each word in a direction of the dictionary."""
        return self.dictionary.where(F.col("dir") == direction).groupBy("src").agg(F.min_by("tgt", "ord").alias("tgt"))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def gold(self) -> DataFrame:
        """Documents that hold an item word for word."""
        return graph.cut(search.containing(self.docs.select(F.col("doc_id").alias("id"), "text"), self.items))

    @cached_property
    def per_query(self) -> DataFrame:
        return search.metrics(self.first_hundred, self.gold, self.items)

    @cached_property
    def all_vec(self) -> DataFrame:
        """Every vector; a label is a concept, the id's parity a language."""
        return self.table("embeddings").select(F.concat(F.lit("L-"), F.col("label")).alias("concept_id"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "en").otherwise("es").alias("lang"), F.col("embedding").cast("array<double>").alias("x"))

    @cached_property
    def vec(self) -> DataFrame:
        """What stores give to training and mining: at most 2,000 rows of each concept and language."""
        return sample.scroll(self.all_vec, 2000)

    @cached_property
    def dist(self) -> DataFrame:
        return vectors.pairs(self.vec, ordered=True)

    @cached_property
    def grid(self) -> DataFrame:
        """Triplets of all rows, not of what stores give."""
        return vectors.mining_grid(self.all_vec, 0.05)
