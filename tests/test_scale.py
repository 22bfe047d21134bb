"""What is dealt out between tasks, and steps that have to stay near-linear."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import oracle
import pandas as pd
from oracle import DATA
from pyspark.sql import functions as F

from tidelex.functions import text
from tidelex.functions.text import focal_span, focal_tokens, token_spans
from tidelex.operators import corpus, encode, graph, inputs, sample, train, vectors, vocab
from tidelex.plans import catalog, further, retrievers, training
from tidelex.plans.base import Base
from tidelex.plans.registry import DigestVectors, HashedGrams


def plan_nodes(df, *kinds):
    """(kind, names of the columns that come out) of the optimised plan's nodes of these kinds."""
    todo, out = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() in kinds:
            cols = node.output()
            out.append((node.nodeName(), [cols.apply(i).name() for i in range(cols.size())]))
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_capped_rows_are_chosen_without_their_sentences(spark):
    nodes = plan_nodes(Base(spark, DATA).points.select("id"), "Window", "RepartitionByExpression")
    assert len(nodes) >= 3 and not any("sentence" in cols for _, cols in nodes)


def test_capped_articles_are_those_of_all_hits(spark):
    r = random.Random(7)
    text = lambda: " ".join(" ".join(r.choices(["uno", "dos", "tres", "one", "two", "four", "five", "seven", "eight"], k=r.randint(4, 9))) + "." for _ in range(r.randint(1, 5)))
    rows = [(i // 2, text(), r.choice(["en", "es"])) for i in range(120)]
    rows += [(None, text(), "en"), rows[5], (rows[5][0], rows[5][1], "es")]  # ids that are missing and rows that are there twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    wc = spark.createDataFrame([(x, w, c) for x in ("en", "es") for w, c in (("one", "C-1"), ("uno", "C-1"), ("two", "C-2"), ("four", "C-1"), ("five", "C-3"))], "lang string, word string, concept_id string")
    arts = corpus.articles(docs)
    hits = corpus.concept_hits(corpus.sized(corpus.sentence_rows(arts.where(F.length("text") >= 50))), wc)
    for per_article, per_concept in ((2, 100), (1, 7), (3, 11)):
        cols = ["lang", "concept_id", "doc_id", "rank", "sent_ord", "word"]
        got, want = sample.capped_articles(arts, wc, per_article, per_concept).collect(), sample.capped(hits, per_article, per_concept).collect()
        key = lambda x: tuple(str(x[c]) for c in cols)
        assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 10
        # Rows of one id may tie; each has a sentence of its own article that holds its word.
        own = {(x.lang, x.doc_id, x.sent_ord, x.word, x.sentence) for x in hits.collect()}
        assert all((x.lang, x.doc_id, x.sent_ord, x.word, x.sentence) in own for x in got)


class Grouped:
    """Takes the place of a table whose groups are handed to a function, to run it here."""

    def groupBy(self, *_):
        return self

    def applyInPandas(self, f, schema):
        return f


def test_clusters_of_a_full_concept_take_little_memory():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)) + rng.integers(0, 3, 1500)[:, None] * 4
    df = pd.DataFrame({"id": range(1500), "x": list(x)})
    tracemalloc.start()
    got = train.kmeans_best(Grouped())(("c",), df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All differences would take 576 MB.
    assert got.k[0] == 3 and peak < 150e6


def test_silhouette_of_blocks_against_all_distances():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(40, 3)), rng.normal(size=(1, 3)) + 50]
    got = train.kmeans_best(Grouped(), ks=(2,))(("c",), pd.DataFrame({"id": range(41), "x": list(x)}))
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    one = np.arange(41) < 40  # the far row is alone, and counts 0
    own, other = d[:40, :40].sum(1) / 39, d[:40, 40]
    assert abs(got.silhouette[0] - ((other - own) / np.maximum(own, other)).sum() / 41) < 1e-12 and one.sum() == 40


def test_focal_tokens_are_those_whose_spans_overlap(spark):
    rows = [("One\ntwo", "two"), ("a one-two b", "one-two"), ("Xtwoy z", "two"), ("none", "two"), ("so", "pass"), ("pre- fix-", "-"), ("tail\n", "ail"), ("a bc", "a b"), ("x", "")]
    df = spark.createDataFrame(rows, "sentence string, word string")
    text = F.concat(F.lit("passage: "), "sentence")
    got = df.select(focal_span(F.col("sentence"), F.col("word")).alias("f"), token_spans(text).alias("s"), focal_tokens(F.col("sentence"), F.col("word")).alias("t")).collect()
    for r in got:
        assert (r.t or []) == [s.token for s in r.s if r.f and s.start < r.f.end and s.end > r.f.start]


def test_no_vector_is_dealt_out_with_a_text(spark):
    docs = spark.createDataFrame([(1, "en", "one two")], "id long, lang string, text string")
    wc = spark.createDataFrame([("en", "one", "C-1"), ("en", "two", "C-1")], "lang string, word string, concept_id string")
    nodes = plan_nodes(encode.concept_vectors(docs, wc, DigestVectors(4)), "Aggregate", "RepartitionByExpression")
    assert nodes and not any("id" in cols and "x" in cols for _, cols in nodes)


def test_spans_of_many_texts_come_in_blocks(spark):
    texts = [None, "", "a b"] + ["Ärger, ¿qué 12 x²?"] * 300
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(token_spans(F.col("t")).alias("s")).collect()]
    assert got[:3] == [[], [], [("a", 0, 1), ("b", 2, 3)]] and len(got) == 303
    assert {tuple(x.token for x in s) for s in got[3:]} == {("ärger", "qué", "x²")}


def test_size_guesses_dont_grow_with_rounds_of_joins(spark):
    rows = graph.cut(spark.range(20).withColumn("k", F.col("id") % 3))
    for _ in range(6):
        rows = graph.cut(rows.join(rows.groupBy("k").agg(F.max("id").alias("m")), "k", "left").select("id", "k"), gone=rows)
    assert rows.count() == 20 and rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_coupled_caps_in_blocks_of_documents_against_a_loop(spark):
    r = random.Random(11)
    rows = sorted({(r.choice(["en", "es"]), r.randint(0, 60), r.randint(0, 3), r.choice("abcdefghijkl")) for _ in range(900)}, key=lambda x: (x[1], x[2], x[0], x[3]))
    concept_, word_, seen, want = Counter(), Counter(), set(), []
    for lang, doc, sent, w in rows:
        c = f"C-{ord(w) % 5}"
        if (lang, doc, sent) not in seen and concept_[c] < 12 and word_[w, lang] < 4:
            seen.add((lang, doc, sent)), want.append((lang, doc, sent, w, c))
            concept_[c] += 1
            word_[w, lang] += 1
    df = spark.createDataFrame([(*x, f"C-{ord(x[3]) % 5}") for x in rows], "lang string, doc_id long, sent_ord long, word string, concept_id string").repartition(3)
    docs = df.select("doc_id").distinct()
    assert sorted(map(tuple, sample.coupled(df, 12, 4, docs=docs, first=4, growth=2, often=3).collect())) == sorted(want)


def test_dictionaries_read_words_that_are_ranked_once(spark):
    b = Base(spark, DATA)
    linked = vocab.linked_dictionary(b.arts, b.ranked)
    assert not any("documents" in f for d in (b.dictionary, linked) for f in d.inputFiles())
    assert sorted(map(tuple, linked.collect())) == sorted(map(tuple, vocab.linked_dictionary(b.arts).collect()))


def test_ranking_stems_no_text_and_deals_out_no_score(spark):
    ranked = Base(spark, DATA).ranked_docs()
    assert not plan_nodes(ranked, "ArrowEvalPython", "BatchEvalPython")
    # One shuffle deals the asked tokens out by id; the other aggregates need none but for terms, and the ranking's own.
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and ", id#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(qid" in x)


def test_asked_rows_are_those_of_all_rows(spark):
    docs = spark.createDataFrame([(1, "Running the runs, ran"), (1, "runs alone"), (2, None), (3, "the x1 " + "y" * 41)], "id long, text string")
    terms = spark.createDataFrame([("run",), ("x1",), ("run",), ("none",)], "term string")
    got, want = encode.asked_rows(docs, terms), encode.token_rows(docs).join(terms.distinct(), "term").select("id", "length", "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3


def test_carved_words_are_those_of_a_row_s_own_language(spark):
    docs = spark.createDataFrame([(1, "en", "cat dog cat"), (1, "es", "cat sol luna y mar")], "id long, lang string, text string")
    wc = spark.createDataFrame([("en", "cat", "C-00002")], "lang string, word string, concept_id string")
    rows = encode.token_rows(docs, stems=None, also=("lang",)).drop("term")
    got = {(r.term, r.concept_id, r.lang, r.length): r.tf for r in encode.backbone_or_concept(rows, wc).collect()}
    assert got == {(None, "C-00002", "en", 3): 2, ("dog", None, "en", 3): 1} | {(w, None, "es", 5): 1 for w in ("cat", "sol", "luna", "y", "mar")}
    assert {r.term for r in encode.lexical_vectors(rows, wc, False).collect()} == {"c:C-00002", "t:dog", "t:cat", "t:sol", "t:luna", "t:y", "t:mar"}


def test_vectors_are_encoded_in_one_pass(spark):
    b = Base(spark, DATA)
    assert not plan_nodes(encode.encode_sparse(b.lang_tokens, b.word_concept, False), "Union")[1:]  # one for the words of both languages


def test_words_are_counted_before_they_meet_concepts(spark):
    b = Base(spark, DATA)
    for df in (b.counts, further.concept_union(b), catalog.lemma_match(b)):
        joined = plan_nodes(df, "Join")
        assert joined and not any({"id", "doc_id", "sent_ord", "words"} & set(cols) for _, cols in joined)
    assert ["lang", "word", "n"] in [cols for _, cols in plan_nodes(b.counts, "Aggregate")]


def test_only_asked_postings_are_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrievers, "cut", lambda df: kept.append(graph.cut(df)) or kept[-1])
    assert retrievers.evaluate(Base(spark, DATA), ("bm25", "lexical"), ("eng-eng",)).count() == 2
    posts, asked = (next(x for x in kept if set(x.columns) == c) for c in ({"part", "id", "term", "d"}, {"run", "part", "qid", "term", "q"}))
    assert posts.join(asked, ["part", "term"], "left_anti").isEmpty() and not posts.isEmpty()


def test_mining_reads_all_rows_of_a_concept(spark, tmp_path):
    """More rows of a concept and language than stores give to training: triplets are mined from all of them, in blocks as from one."""
    r = np.random.default_rng(5)
    n = [2 * i for i in range(2010)] + [2 * i + 1 for i in range(30)]
    rows = [(i, r.normal(size=3).round(3).tolist(), 0) for i in n] + [(5001 + i, [1.0, float(i), 0.0], 1) for i in range(3)] + [(6000, None, 0), (6002, [0.0, 0.0, 0.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    grid = catalog.queries()["mining_grid"](spark, str(tmp_path))
    assert grid.where("lang_a = 'en' and lang_b = 'en'").select("a").distinct().count() > 2000
    oracle.check(con, grid, catalog.oracle_sql()["mining_grid"])
    few = Base(spark, str(tmp_path)).all_vec.where("id < 300")
    whole, blocks = (vectors.mining_grid(few, 0.05, **k) for k in ({}, {"anchors": 40, "others": 70, "step": 16}))
    assert sorted(whole.collect()) == sorted(blocks.collect()) and whole.count() > 1000
    for name in ("rejection_rate", "sampler_stats", "triplet_audit", "triplet_loss"):
        oracle.check(con, catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name])


def test_buckets_are_of_all_concepts(spark):
    got = catalog.queries()["bucket_lookup"](spark, DATA).select(F.col("concept_id").substr(3, 20).cast("long").alias("c")).distinct().toPandas()
    assert set(got.c % 5) == set(range(5))


def test_concept_vectors_are_given_whole(spark):
    """The pooled vector itself, not only its length, of each document and concept: counts times vectors of the concept's words."""
    got = catalog.queries()["concept_vectors"](spark, DATA).where("id < 3").collect()
    b = Base(spark, DATA)
    of = {(r.lang, r.word): r.concept_id for r in b.word_concept.collect()}
    n = Counter((r.doc_id, of[r.lang, t], t) for r in b.arts.where("doc_id < 3").select("doc_id", "lang", text.tokens(F.col("text")).alias("t")).collect() for t in r.t if (r.lang, t) in of)
    words = spark.createDataFrame([(t,) for t in {k[2] for k in n}], "text string")
    x = {r.text: np.array(r.x, float) for r in HashedGrams(16).embed(words).collect()}
    want = {}
    for (doc, c, t), k in n.items():
        want[doc, c] = want.get((doc, c), 0) + k * x[t]
    assert len(got) == len(want) > 10
    for r in got:
        v = want[r.id, r.concept_id]
        assert np.allclose(r.x, v / max(np.linalg.norm(v), 1e-12), atol=1e-5) and abs(np.linalg.norm(r.x) - r.length) < 1e-3


def test_copies_are_cut_once_a_row(spark):
    """However many forms a concept has, a sentence is parted, bared and cut once for each row, and stored rows are written once for all that read them."""
    points = spark.createDataFrame([("a", "C-1", "en", "x " * 9 + "(Bank) " + "y " * 9)], "id string, concept_id string, lang string, sentence string")
    targets = spark.createDataFrame([("C-1", "en", w) for w in ("bank", "banks", "river")], "concept_id string, lang string, word string")
    made = inputs.augmented_inputs(points, targets)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("array_position(", "split(", "array_join(")] == [1, 1, 1]
    assert [r.sentence for r in made.collect()] == ["x x x x x (Bank) y y y y y"]
    b = Base(spark, DATA)
    assert "Window" not in b.stored._jdf.queryExecution().optimizedPlan().toString() and b.stored.count() == b.latest.count()


def test_selected_rows_are_those_of_all_that_are_selected(spark):
    """Only the selected concepts' words are looked at; what is found is what choosing among all stored rows gives."""
    b = Base(spark, DATA)
    got, want = training.selected(b), b.stored.join(training.demanded(b), "concept_id", "left_semi")
    assert 0 < got.count() < b.stored.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
