"""Literal fixtures for single operators."""

import hashlib
import json
import random
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.functions.hashing import murmur3
from tidelex.functions.stem import stem, stems_of
from tidelex.functions.text import highlighted, label_of, name_uuid, sentences, shift_spans
from tidelex.operators import encode, graph, sample, search, train, vectors, vocab
from tidelex.operators.train import Adam, Plateau
from tidelex.plans import registry
from tidelex.sources import readers, store


def test_murmur3_public_vectors():
    assert murmur3(["", "foo", "hello"]).tolist() == [0, -156908512, 613153351]


def test_stemmer():
    words = {"consistently": "consist", "ponies": "poni", "running": "run", "hopping": "hop", "national": "nation", "happy": "happi", "ties": "tie", "cries": "cri", "agreed": "agre", "generously": "generous", "skies": "sky", "by": "by", "say": "say", "knack": "knack", "consolation": "consol"}
    assert {w: stem(w) for w in words} == words


def test_sentences_and_spans(spark):
    df = spark.createDataFrame([(" One. Two!  Three? four ",), ("",)], "t string").select(sentences(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [["One.", "Two!", "Three?", "four"], []]
    s = spark.sql("SELECT array(named_struct('start', 1, 'end', 4)) AS s").select(shift_spans(F.col("s"), F.lit(9)).alias("s")).first().s[0]
    assert (s.start, s.end) == (10, 13)


def test_backbone_counts_carved_tokens_in_the_length(spark):
    cfg = encode.Bm25(avg_len=4.0)
    rows = encode.token_rows(spark.createDataFrame([(1, "cat sat reykjavik")], "id long, text string"), (), cfg)
    carve = spark.createDataFrame([(1, "cat")], "id long, token string")
    got = {r.term: r.weight for r in encode.backbone_doc(rows, carve, cfg).collect()}
    assert set(got) == {"sat", "reykjavik"}
    assert got["sat"] == pytest.approx(2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 4)), abs=1e-6)
    q = encode.backbone_query(encode.token_rows(spark.createDataFrame([(1, "foo foo foo bar")], "id long, text string"), ())).collect()
    assert sorted((r.term, r.weight) for r in q) == [("bar", 1.0), ("foo", 1.0)]


def test_stems_share_a_term_and_only_whole_tokens_are_carved(spark):
    cfg = encode.Bm25(avg_len=4.0)
    w = lambda tf, n: pytest.approx(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 4)), abs=1e-6)
    toy = lambda c: F.transform(c, lambda t: F.regexp_replace(t, "s$", ""))
    docs = spark.createDataFrame([(1, "food foods"), (2, None), (3, "the cat , !"), (4, "cat dog")], "id long, text string")
    rows = encode.token_rows(docs, ("the",), cfg, toy)
    of = lambda carve: {(r.id, r.term): r.weight for r in encode.backbone_doc(rows, spark.createDataFrame(carve, "id long, token string"), cfg).collect()}
    assert of([(9, "x")]) == {(1, "food"): w(2, 2), (3, "cat"): w(1, 1), (4, "cat"): w(1, 2), (4, "dog"): w(1, 2)}
    assert of([(1, "food"), (4, "cat"), (4, "dog")]) == {(1, "food"): w(1, 2), (3, "cat"): w(1, 1)}


def test_stems_of_arrays(spark):
    df = spark.createDataFrame([(["ponies", "running", "ponies"],), ([],), (None,), (["sky"],)], "t array<string>").coalesce(1)
    assert [r[0] for r in df.select(stems_of("t")).collect()] == [["poni", "run", "poni"], [], None, ["sky"]]


def test_sparse_vectors_by_hand(spark):
    """A query and a document with a concept word: its stem leaves the backbone, its concept comes in; with heads, the block is the head's."""
    wc = spark.createDataFrame([("en", "bank", "C-00001"), ("en", "banks", "C-00001")], "lang string, word string, concept_id string")
    rows = encode.token_rows(spark.createDataFrame([(1, "Bank rivers bank banks river")], "id long, text string")).withColumn("lang", F.lit("en"))
    at = encode.lexical_index
    river = spark.createDataFrame([("river",)], "t string").select(at("t")).first()[0]
    w = lambda tf: round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 5 / 256)), 6)
    assert {(r.idx, r.value) for r in encode.encode_sparse(rows, wc, False).collect()} == {(river, w(2)), (8, w(3))}
    assert {(r.idx, r.value) for r in encode.encode_sparse(rows, wc, True, 0.5).collect()} == {(river, 0.5), (8, 1.0)}
    learned = spark.createDataFrame([(1, "C-00001", [1.0, 0.0], [[1.0, 5.0], [-1.0, 2.0], [0.0, 9.0]])], "id long, concept_id string, x array<double>, weights array<array<double>>")
    got = {r.idx: r.value for r in encode.encode_sparse(rows, wc, False, learned=learned).collect()}
    assert set(got) == {river, 8, 9} and got[8] == pytest.approx(w(3) / 2**0.5, abs=1e-6) and got[9] == -got[8]


def test_hit_without_head_blocks_the_lemma(spark):
    rows = spark.createDataFrame([(1, "en", "banks"), (1, "en", "loans")], "id long, lang string, token string")
    wc = spark.createDataFrame([("en", "bank", "C-00001"), ("en", "banks", "C-00002"), ("en", "loan", "C-00003")], "lang string, word string, concept_id string")
    lemmas = spark.createDataFrame([("en", "banks", "bank"), ("en", "loans", "loan")], "lang string, form string, lemma string")
    heads = spark.createDataFrame([("C-00001",), ("C-00003",)], "concept_id string")
    assert [(r.token, r.concept_id) for r in encode.matches(rows, wc, lemmas, heads).collect()] == [("loans", "C-00003")]


def test_pooling_fixture(spark):
    tok = spark.createDataFrame([("a", 0, 0, [9.0, 9.0, 9.0]), ("a", 0, 4, [1.0, 0.0, 0.0]), ("a", 5, 9, [0.0, 1.0, 0.0]), ("a", 5, 9, [0.0, 0.0, 1.0])], "id string, s int, e int, x array<double>")
    spans = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 5, 9)], "id string, occ int, start int, end int")
    h = np.array([0, 0.5, 0.5]) / np.linalg.norm([0, 0.5, 0.5])
    want = (np.array([1.0, 0, 0]) + h) / 2
    assert np.allclose(vectors.pooled(tok, spans).first().x, want / np.linalg.norm(want))


def test_metrics_fixture(spark):
    run = spark.createDataFrame([(1, "g", 1), (2, "x", 1), (2, "y", 2), (2, "g", 3)], "qid long, id string, rank long")
    rel = spark.createDataFrame([(1, "g"), (2, "g"), (3, "z")], "qid long, id string")
    got = {r.qid: (r.ndcg10, r.r100, r.mrr10) for r in search.metrics(run, rel, spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.5, 1.0, 0.333333), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_pair_grid_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 4))
    rows = spark.createDataFrame([("C", i, "en", x[i].tolist()) for i in range(7)], "concept_id string, id int, lang string, x array<double>")
    got = sorted((r.a, r.pos, r.neg) for r in vectors.pair_grid(vectors.pairs(rows, ordered=True), 0.1).collect())
    n = np.linalg.norm(x, axis=1)
    d = np.round(1 - x @ x.T / (n[:, None] * n[None] + 1e-8), 6)
    want = sorted((a, *((p, q) if d[a, p] <= d[a, q] else (q, p))) for a in range(7) for p in range(7) for q in range(p + 1, 7) if a not in (p, q) and round(abs(d[a, p] - d[a, q]), 6) >= 0.1)
    assert got == want


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    w, x = rng.normal(size=(3, 6)), rng.normal(size=(5, 5, 6))
    margin, use = rng.uniform(0.2, 0.6, (5, 2)), np.array([[1, 1], [1, 0], [1, 1], [1, 0], [1, 1]], float)
    _, g = train.loss_and_gradient(w, x, margin, use)
    for i, j in ((0, 0), (1, 3), (2, 5)):
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        want = (train.loss_and_gradient(w + e, x, margin, use)[0] - train.loss_and_gradient(w - e, x, margin, use)[0]) / 2e-6
        assert g[i, j] == pytest.approx(want, abs=1e-6)


def test_adam_and_plateau():
    a = Adam((1,), 0.1)
    assert a.step(np.array([1.0]), np.array([3.0]))[0] == pytest.approx(0.9, abs=1e-6)
    p, rate, seen = Plateau(0.5, 1), 1.0, []
    for loss in (1.0, 1.0, 1.0, 0.5, 0.5, 0.5):
        rate = p.rate(rate, loss)
        seen.append(rate)
    assert seen == [1.0, 1.0, 0.5, 0.5, 0.5, 0.25]


def test_components_of_long_chains(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60) if i % 20 != 19]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert all(c == f"n{int(n[1:]) // 20 * 20:03}" for n, c in got.items()) and len(got) == 60


def test_louvain_finds_cliques():
    ends = [(a + k, b + k) for k in (0, 5, 10) for a in range(5) for b in range(a + 1, 5)] + [(4, 5), (9, 10)]
    label = graph.louvain(15, np.array(ends), np.ones(len(ends)), 1.0, float(len(ends)), 1)
    assert len(set(label)) == 3 and all(len(set(label[k : k + 5])) == 1 for k in (0, 5, 10))


def test_communities_divide_and_stay():
    """Two cliques on a bridge come apart; a clique above the limit goes in single nodes at most, and says so where nothing divides it."""
    ends = np.array([(a + k, b + k) for k in (0, 5) for a in range(5) for b in range(a + 1, 5)] + [(4, 5)])
    part, depth, stuck = graph.communities(ends, np.ones(len(ends)), 10, 1.0, float(len(ends)), 5, graph.linear(0.5), 1)
    assert len(set(part)) == 2 and set(depth) == {0} and not stuck.any()
    part, depth, stuck = graph.communities(ends, np.ones(len(ends)), 10, 1.0, 1e9, 5, graph.linear(0.5), 1)
    assert len(set(part)) == 2 and set(depth) == {1} and not stuck.any()
    one = np.array([(0, 1), (0, 2), (1, 2)])
    part, depth, stuck = graph.communities(one, np.ones(3), 3, 0.1, 3.0, 2, graph.linear(0.01), 1)
    assert stuck.all() and len(set(part)) == 1


@pytest.mark.parametrize("params", [{}, {"bundle_edges": 8}, {"large_edges": 3, "bundle_edges": 8}])
def test_louvain_in_bundles_and_by_joins(spark, params):
    edges = [(f"n{a + k:02}", f"n{b + k:02}", 1) for k in (0, 6, 12) for a in range(6) for b in range(a + 1, 6)] + [("n05", "n06", 1), ("n11", "n12", 1), ("x", "y", 2)]
    links = spark.createDataFrame(edges, "u string, v string, weight long")
    got = {r.node: (r.component, r.part) for r in graph.louvain_parts(links, graph.components(links), 1.0, **params).collect()}
    want = {f"n{i:02}": ("n00", f"n{i // 6 * 6:02}") for i in range(18)} | {"x": ("x", "x"), "y": ("x", "x")}
    assert got == want


def test_louvain_by_joins_is_about_as_good(spark):
    rng = np.random.default_rng(3)
    group = rng.integers(0, 4, 40)
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < (0.5 if group[i] == group[j] else 0.02)]
    links = spark.createDataFrame([(f"{a:02}", f"{b:02}", 1) for a, b in pairs], "u string, v string, weight long")
    q = lambda parts: graph.modularity(links, parts).first()[0]
    names = sorted({f"{x:02}" for p in pairs for x in p})
    local = graph.louvain(len(names), np.array([[names.index(f"{a:02}"), names.index(f"{b:02}")] for a, b in pairs]), np.ones(len(pairs)), 1.0, float(len(pairs)), 1)
    best = q(spark.createDataFrame([(n, str(c)) for n, c in zip(names, local.tolist(), strict=True)], "node string, component string"))
    assert q(graph.moved_parts(links, 1.0, float(len(pairs)), rounds=6, levels=2).withColumnRenamed("part", "component")) > 0.8 * best > 0.2


def test_heldout_recall_by_hand(spark):
    parts = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "node string, component string")
    held = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "u string, v string")
    assert tuple(graph.recall_of(held, parts).first()) == (2, 0.5)


def test_tally_counts_wins(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1)], "name string, q double")
    assert {r.name: (r.wins, r.ties, r.losses) for r in graph.tally(rows, "q").collect()} == {"a": (1, 1, 0), "b": (1, 1, 0), "c": (0, 0, 2)}


def test_schedules_show_depth(spark):
    edges = [(f"n{a + k:02}", f"n{b + k:02}", 1) for k in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [("n03", "n04", 1)]
    links = spark.createDataFrame(edges, "u string, v string, weight long")
    got = {r.name: r for r in graph.schedules(links, graph.components(links), {"linear": graph.linear(0.5), "none": lambda g: g}, most=3, gamma=0.01).collect()}
    assert got["linear"].depths != "0=8" and got["none"].undivided == 8 and got["linear"].parts > got["none"].parts


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    x[7], x[8] = x[20], x[20] * 2  # ties
    rows = spark.createDataFrame([(i, f"C{i % 3}", x[i].tolist()) for i in range(40)], "id long, concept_id string, x array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    got = {r.a: (r.b, r.cosine) for r in vectors.nearest(rows.where("id < 10"), rows.where("id >= 5"), block=4, step=3).collect()}
    assert got == {a: (b := max(range(5, 40), key=lambda j: (cos[a, j], -j)), pytest.approx(cos[a, b])) for a in range(10)}
    assert vectors.nearest(rows.limit(0), rows).count() == 0


def test_containing_against_in(spark):
    texts = {1: "a cat sat", 2: "cat", 3: "", 4: None, 5: "the cats", 6: "tac"}
    items = {10: "cat", 11: "at s", 12: "", 13: "cat", 14: "dog", 15: None}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    q = spark.createDataFrame(list(items.items()), "qid long, text string")
    want = sorted((k, i) for k, p in items.items() if p for i, t in texts.items() if t and p in t)
    for chars in (1 << 20, 4):
        assert sorted(tuple(r) for r in search.containing(d, q, chars).collect()) == want


def test_tree_digest_by_hand(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(k, h(str(k))) for k in (0, 1, 2, 3, 4, 9, 17)]
    level = dict(rows)
    for last in (False, False, True):
        up = {}
        for k in sorted(level):
            up.setdefault(0 if last else k >> 2, []).append(level[k])
        level = {k: h("".join(v)) for k, v in up.items()}
    assert search.tree_digest(spark.createDataFrame(rows, "key long, h string"), bits=2, levels=3).first().digest == level[0]


def test_text_helpers(spark):
    df = spark.createDataFrame([("A Bank, banks and BANK.", "bank", ["river", "x"], [])], "s string, w string, en array<string>, es array<string>")
    got = df.select(highlighted(F.col("s"), F.col("w")).alias("h"), label_of(F.col("en"), F.col("es"), 3).alias("l"), name_uuid(F.lit("example.org")).alias("u")).first()
    assert (got.h, got.l, got.u) == ("A *Bank*, banks and *BANK*.", "riv", str(uuid.uuid5(uuid.NAMESPACE_DNS, "example.org")))


def test_coupled_caps_against_a_loop(spark):
    r = random.Random(4)
    rows = sorted({(r.choice(["en", "es"]), r.randint(0, 30), r.randint(0, 3), r.choice("abcdefgh")) for _ in range(300)}, key=lambda x: (x[1], x[2], x[0], x[3]))
    hits = [(*x, f"C-{ord(x[3]) % 3}") for x in rows]
    concept, word, seen, want = {}, {}, set(), []
    for lang, doc, sent, w, c in hits:
        if (lang, doc, sent) not in seen and concept.get(c, 0) < 9 and word.get((w, lang), 0) < 3:
            seen.add((lang, doc, sent))
            concept[c], word[w, lang] = concept.get(c, 0) + 1, word.get((w, lang), 0) + 1
            want.append((lang, doc, sent, w, c))
    df = spark.createDataFrame(r.sample(hits, len(hits)), "lang string, doc_id long, sent_ord long, word string, concept_id string").repartition(4)
    assert sorted(map(tuple, sample.coupled(df, 9, 3).collect())) == sorted(want)


def test_vectors_of_sentences_and_concepts(spark):
    p = registry.HashedGrams(8)
    pts = spark.createDataFrame([("a", "en", "one"), ("b", "en", "one"), ("c", "es", "two")], "id string, lang string, sentence string")
    got = {r.id: r.x for r in encode.sentence_vectors(pts, p).collect()}
    assert got["a"] == got["b"] != got["c"]
    wc = spark.createDataFrame([("en", "bank", "C-1"), ("en", "banks", "C-1"), ("en", "river", "C-2")], "lang string, word string, concept_id string")
    docs = spark.createDataFrame([(1, "en", "Bank by the bank, banks"), (2, "en", "nothing")], "id long, lang string, text string")
    v = encode.concept_vectors(docs, wc, p).collect()
    x = {r.text: np.array(r.x, float) for r in p.embed(spark.createDataFrame([("bank",), ("banks",)], "text string")).collect()}
    want = (2 * x["bank"] + x["banks"]) / 3
    assert [(r.id, r.concept_id) for r in v] == [(1, "C-1")] and np.allclose(v[0].x, want / np.linalg.norm(want), atol=1e-6)
    assert encode.pooling_of("remote", "sentence") == "sentence"
    for bad in (("remote", "token"), ("x", "token")):
        with pytest.raises(ValueError):
            encode.pooling_of(*bad)


def test_plane_against_eigenvectors(spark):
    x = np.random.default_rng(5).normal(size=(12, 4)) * [5, 3, 1, 0.1]
    got = train.plane(spark.createDataFrame([("C", i, x[i].tolist()) for i in range(12)], "concept_id string, id long, x array<double>")).orderBy("id").toPandas()
    _, axes = np.linalg.eigh(np.cov(x.T))
    want = np.abs((x - x.mean(0)) @ axes[:, [3, 2]])
    assert np.allclose(np.abs(got[["u", "v"]].to_numpy()), want)


def test_collections(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"))
    row = lambda i, n: spark.createDataFrame([(i, [0.5] * n)], "id string, x array<double>")
    with pytest.raises(ValueError, match="known"):
        c.create(None)
    assert c.create(3) == "created" and c.create(3) == "kept"
    c.add(row("a", 3), 1)
    c.add(row("a", 3), 2)
    assert c.points().count() == 1
    with pytest.raises(ValueError, match="places"):
        c.create(4)
    with pytest.raises(ValueError, match="places"):
        c.add(row("b", 2), 3)
    assert c.create(4, recreate=True) == "recreated" and store.read_or_none(spark, str(tmp_path / "c/points")) is None


def test_backup_is_made_once(spark, tmp_path):
    at, n = str(tmp_path / "v"), lambda p: spark.read.parquet(p).first()[0]
    for k in range(3):
        store.replace_with_backup(spark.range(k, k + 1) if k < 2 else spark.read.parquet(at).selectExpr("id + 1 AS id"), at)
        assert n(at) == k
    assert n(at + "_full") == 0


def test_caches_are_made_once(spark, tmp_path):
    calls = []
    for kind in ("tsv", "frozen"):
        make = lambda: calls.append(1) or spark.createDataFrame([("1", 'a "b" c'), ("2", "")], "k string, v string")
        read = lambda: store.tsv_cache(spark, str(tmp_path / "t"), make, "k string, v string") if kind == "tsv" else store.frozen(spark, str(tmp_path / "f"), make)  # noqa: B023, E731
        assert {(r.k, r.v or "") for _ in range(2) for r in read().collect()} == {("1", 'a "b" c'), ("2", "")}
    assert len(calls) == 2


def test_translations_are_asked_for_once(spark, tmp_path):
    asked = []

    def provider(df):
        asked.append(sorted(r.text for r in df.collect()))
        return df.select("key", F.upper("text").alias("translation"))

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    go = lambda df: {r.text: r.translation for r in store.translate(spark, str(tmp_path / "c"), df, "m", "en", "es", provider).collect()}
    assert go(texts("a", "b", "a")) == {"a": "A", "b": "B"} and go(texts("b", "c")) == {"b": "B", "c": "C"} and go(texts("c")) == {"c": "C"}
    assert asked == [["a", "b"], ["c"]]


def test_tab_separated_collection(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    p = {"en": put("pe", "0\tThe bank approved it\n1\tA river\tdelta\n2\tThe bank approved it\n3\tnever asked\n"), "es": put("ps", "0\tEl banco\n1\tUn delta\n")}
    q = {"en": put("qe", "10\tbank?\n11\triver?\n12\tother?\n")}
    corpus, asked, gold = readers.collection(spark, p, q, put("r", "10\t0\t0\t1\n10\t0\t2\t1\n11\t0\t1\t1\n13\t0\t9\t1\n"))
    h = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert {(r.lang, r.id) for r in corpus.collect()} == {("en", h("The bank approved it")), ("en", h("A river\tdelta")), ("es", h("El banco")), ("es", h("Un delta"))} and corpus.count() == 4
    assert sorted(r.qid for r in asked.collect()) == ["10", "11"]
    assert {(r.lang, r.qid, r.id) for r in gold.collect() if r.lang == "en"} == {("en", "10", h("The bank approved it")), ("en", "11", h("A river\tdelta"))}
    rest = spark.createDataFrame([("en", i, h(t), t) for i, t in enumerate(["A river\tdelta", "x", "y", "x", "z"])], "lang string, ord long, id string, text string")
    assert sorted(r.text for r in readers.with_distractors(corpus, rest, 2).where("lang = 'en'").collect()) == ["A river\tdelta", "The bank approved it", "x", "y"]


def test_questions_in_archives(spark, tmp_path):
    body = lambda i: json.dumps({"data": [{"paragraphs": [{"context": f"c{i}", "qas": [{"id": str(i), "question": "?"}]}]}]})
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("dev/en-es.json", "dev/es-en.json", "notes.txt"):
            z.writestr(name, body(len(name)))
    q, p = readers.zipped_questions(spark, str(tmp_path / "a.zip"), r"^dev/en-")
    assert [r.qid for r in q.collect()] == ["14"] and p.first().text == "c14"


def test_rates_rest_after_a_cut_and_have_a_floor():
    p, rate, seen = Plateau(0.5, 0, cooldown=2, least=0.3), 1.0, []
    for _ in range(8):
        rate = p.rate(rate, 1.0)
        seen.append(rate)
    assert seen == [1.0, 0.5, 0.5, 0.5, 0.3, 0.3, 0.3, 0.3]


def test_anchors_come_from_both_languages():
    lang = np.array(["en"] * 90 + ["es"] * 10)
    x = np.random.default_rng(0).normal(size=(100, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at, _, _ = train.Sampler(1 - u @ u.T, lang, 0.05).draw(np.random.default_rng(1), 400)
    assert 0.35 < (lang[at[:, 0].astype(int)] == "es").mean() < 0.65


def test_subset_names_missing_ids(spark):
    v = spark.createDataFrame([("C-00001",)], "concept_id string")
    with pytest.raises(ValueError, match="C-00009"):
        vocab.subset(v, spark.createDataFrame([("C-00009",)], "concept_id string"))


def test_readers(spark, tmp_path):
    (tmp_path / "d.txt").write_text("The  El extra\nalone\n\tCat gato\n")
    assert [(r.src, r.tgt) for r in readers.dictionary(spark, str(tmp_path / "d.txt")).orderBy("ord").collect()] == [("the", "el"), ("cat", "gato")]
    (tmp_path / "c.tsv").write_text("0\tone\ttab\n1\ttwo\n0\tlast\n")
    assert {r.key: r.value for r in readers.key_values(spark, str(tmp_path / "c.tsv")).collect()} == {"0": "last", "1": "two"}
    (tmp_path / "r.tsv").write_text("10\t0\t7\t1\n")
    assert tuple(readers.relevance(spark, str(tmp_path / "r.tsv")).first()) == ("10", "7")
    (tmp_path / "v.json").write_text(json.dumps({"C-1": {"en": ["a"], "es": ["b"]}}))
    assert tuple(readers.vocabulary(spark, str(tmp_path / "v.json")).first()) == ("C-1", ["a"], ["b"])
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"paragraphs": [{"context": "x", "qas": [{"id": "1", "question": "?"}]}]}]}))
    q, p = readers.question_set(spark, str(tmp_path / "q.json"))
    assert q.first().id == p.first().id and q.first().question == "?"


def test_splits_are_sealed_by_digest(spark, tmp_path):
    m = store.write_splits(str(tmp_path), {"dev": ["1", "2"]}, 42)
    at = str(tmp_path / "dev.json")
    assert readers.split_ids(at, m["files"]["dev.json"]["sha256"]) == ["1", "2"]
    with pytest.raises(FileExistsError):
        store.write_splits(str(tmp_path), {"dev": []}, 42)
    (tmp_path / "dev.json").write_text("[]")
    with pytest.raises(ValueError, match="differs"):
        readers.split_ids(at, m["files"]["dev.json"]["sha256"])


def test_index_reuse_rule(spark, tmp_path):
    i = store.Index(spark, str(tmp_path))
    make = lambda: spark.createDataFrame([(1, "a", 1.0)], "id long, term string, d double")
    with pytest.raises(RuntimeError):
        i.postings("en")
    assert i.build("en", "d1", 1, make) == "built"
    assert i.build("en", "d1", 1, make) == "reused"
    with pytest.raises(store.CorpusChanged):
        i.build("en", "d2", 1, make)
    assert i.build("en", "d2", 1, make, rebuild=True) == "replaced"
    assert i.postings("en").count() == 1


def test_upsert_heads_and_cache(spark, tmp_path):
    row = lambda v: spark.createDataFrame([("a", v)], "id string, v int")
    for n, v in ((1, 1), (2, 2), (2, 3)):
        store.upsert(spark, str(tmp_path / "p"), row(v), n)
    assert store.current(spark, str(tmp_path / "p")).first().v == 3
    heads = spark.createDataFrame([("C-1", 1.0), ("C-2", 2.0)], "concept_id string, w double")
    store.save_heads(str(tmp_path / "h"), heads, "r1", 0)
    store.save_heads(str(tmp_path / "h"), heads.where("concept_id = 'C-1'").withColumn("w", F.lit(9.0)), "r2", 0)
    assert {r.concept_id: r.w for r in store.merged_heads(spark, str(tmp_path / "h")).collect()} == {"C-1": 9.0, "C-2": 2.0}
    calls = []
    for _ in range(2):
        store.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or heads, vocab="x", lang="en").count()
    assert len(calls) == 1


def test_report_baseline_and_registry(spark, tmp_path):
    at = store.write_report(str(tmp_path), "bm25", "abcdef012345", {"en": {"mrr": 0.5}}, {"old": {"en": {"mrr": 0.6}}})
    assert at.endswith("__bm25__abcdef0") and "| 0.5000 | -0.1000 |" in open(at + ".md").read()
    store.lock_baseline(str(tmp_path / "b.json"), "bm25", "en", "test", "mrr", 0.5, at, "abc", False)
    with pytest.raises(ValueError):
        store.lock_baseline(str(tmp_path / "b.json"), "bm25", "en", "test", "mrr", 0.5, at, "abc", True)
    with pytest.raises(ValueError, match="report"):
        store.lock_baseline(str(tmp_path / "b.json"), "bm25", "en", "test", "mrr", 0.5, at, "abc", False, "abd")
    held = lambda v, names: store.check_baselines(str(tmp_path / "b.json"), {"en": {"mrr": v}}, {"en": names}, "test", "mrr")
    assert not held(0.6, ["bm25", "unknown"]) and held(0.5, ["bm25"]) and not held(0.1, ["unknown"])
    store.audit(str(tmp_path / "a.tsv"), "run", "en")
    assert open(tmp_path / "a.tsv").read().count("\t") == 2
    r = registry.Registry("thing")
    r.register("x")(1)
    with pytest.raises(ValueError):
        r.register("x")(2)
    with pytest.raises(KeyError):
        r.get("y")
    with pytest.raises(PermissionError):
        registry.guard_test_split("test", False)


def test_provider_gives_unit_vectors(spark):
    x = registry.HashedGrams(16).embed(spark.createDataFrame([("hello world",), ("hello world",)], "text string")).collect()
    assert len(x) == 1 and np.linalg.norm(x[0].x) == pytest.approx(1.0, abs=1e-5)


def test_streaming_ingest_resumes_and_caps(spark, tmp_path):
    from tidelex.streaming import ingest

    wc = spark.createDataFrame([("en", "bank", "C-00001")], "lang string, word string, concept_id string")
    rows = [("en", i, f"The old bank number {random.Random(i).random()} near our river was very large indeed today.") for i in range(12)]
    put = lambda a, b: spark.createDataFrame(rows[a:b], ingest.ARTICLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), wc, str(tmp_path / "out"), str(tmp_path / "cp"), cap=8)
    put(0, 5)
    run()
    assert ingest.stored(spark, str(tmp_path / "out")).count() == 5
    put(5, 12)
    run()
    assert ingest.stored(spark, str(tmp_path / "out")).count() == 8


def test_ingest_reads_sentences_again_only_for_rows_that_stay(spark, tmp_path):
    """What goes to the state holds no sentence; each stored row still has its own, also where one id comes twice."""
    from tidelex.streaming import ingest

    wc = spark.createDataFrame([("en", "bank", "C-1"), ("en", "river", "C-1"), ("en", "old", "C-2")], "lang string, word string, concept_id string")
    text = lambda i: f"Too short here. The old bank number {'abcdef'[i]} was very large. A river near the bank {'abcdef'[i]} ran high. No concept stands in this one."
    rows = [("en", i, text(i)) for i in range(5)] + [("en", 4, text(5)), ("en", 9, None)]
    spark.createDataFrame(rows, ingest.ARTICLE).coalesce(1).write.parquet(str(tmp_path / "in"))
    arts = spark.read.schema(ingest.ARTICLE).parquet(str(tmp_path / "in"))
    places = ingest.places_of(arts, wc)
    assert "sentence" not in places.columns and "sentence" not in ingest.PLACES
    columns = ["lang", "concept_id", "doc_id", "sent_ord", "word", "sentence"]
    want = sorted(map(tuple, ingest.hits_of(arts, wc).select(columns).collect()))
    assert sorted(map(tuple, ingest.with_sentences(places).select(columns).collect())) == want and len(want) == 24
    ingest.ingest(spark, str(tmp_path / "in"), wc, str(tmp_path / "out"), str(tmp_path / "cp"), cap=7, per_article=1)
    got = ingest.stored(spark, str(tmp_path / "out")).select(columns).collect()
    assert set(map(tuple, got)) <= set(want) and {(r.concept_id, r.doc_id) for r in got} == {(c, i) for c in ("C-1", "C-2") for i in range(5)}
    assert len(got) == 10
