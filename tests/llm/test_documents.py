"""The operators on documents, against brute force, on fixtures and on whole small tables."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle
from oracle import DATA
from tidelex.llm import components, decontam, exact_dedup, lm, mixing, quality, queries, simhash, textvec, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    oracle.check(con, queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


# 1 Toxicity


def brute_segments(s):
    """All maximal-scoring segments by their definition: the best one, then the same left and right of it."""
    if not len(s):
        return []
    best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, i, j = best
    return brute_segments(s[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in brute_segments(s[j:])]


def test_maximal_segments_against_their_definition():
    r = random.Random(3)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 5]) + r.random() / 100 for _ in range(r.randint(0, 14))]
        c = np.r_[0, np.cumsum(s)]
        at = [i for i, v in enumerate(s) if v > 0]
        got = [(at[a], at[b]) for a, b in toxicity.maximal_segments([c[i] for i in at], [c[i + 1] for i in at])]
        assert got == brute_segments(s)


def test_lambda_is_the_root():
    lam = toxicity.solve_lambda(np.array([2.0, -1.0]), np.array([0.2, 0.8]))
    assert 0.2 * math.exp(2 * lam) + 0.8 * math.exp(-lam) == pytest.approx(1.0, abs=1e-6) and lam > 1e-3


def toxic_table(spark, n=600):
    r = random.Random(5)
    vocab = ["w%03d" % i for i in range(200)]
    rows, marks = [], []
    for i in range(n):
        t, bad = [r.choice(vocab) for _ in range(r.randint(20, 60))], i % 4 == 0
        if bad:
            for _ in range(4):
                t.insert(r.randrange(len(t)), r.choice(["vile", "nasty", "grimstem" + r.choice("abcdefgh")]))
        rows.append((i, " ".join(t)))
        marks.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    d, y = toxic_table(spark)
    got = toxicity.flag(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.toxic).mean() > 0.95
    assert got[got.toxic == 1].segments.map(len).min() >= 1
    kept = {r.doc_id for r in toxicity.remove(d, y).collect()}
    assert kept == {r.doc_id for r in toxicity.flag(d, y).where("predicted = 0").collect()}


def test_toxicity_odd_rows(spark, odd, none):
    _, y = toxic_table(spark, 8)
    one = y.limit(0)
    assert {r.score for r in toxicity.flag(odd, one).collect()} == {0.0}
    d, y = toxic_table(spark)
    model = toxicity.train(d, y.unionByName(y))
    out = toxicity.score(odd, model).collect()
    assert len(out) == 11 and all(0 <= r.score_ <= 1 and r.segments == [] for r in out) and {r.score for r in out} == {r.score for r in odd.collect()}
    assert toxicity.flag(none, y).count() == 0
    assert toxicity.remove(odd, y).columns == odd.columns and toxicity.remove(odd, y).count() == 11


def test_toxicity_query_against_brute_force(spark):
    """Every row of the query: segments by their definition over the tokens' scores, and the curve's value at their evidence."""
    model = toxicity.train(docs(spark), labels(spark))
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, DATA).collect()}
    rows = docs(spark).collect()
    every = sorted({w for r in rows for w in words(r.text)})
    known = np.zeros(len(every))
    for at, hs, has in textvec.word_features(pa.array(every), toxicity.PREFIXES):
        for h, ok in zip(hs, has, strict=True):
            np.maximum.at(known, at[ok], model["scores"][toxicity._buckets(h[ok])])
    token = dict(zip(every, known - model["drift"], strict=True))
    for r in rows:
        s = [token[w] for w in words(r.text)]
        c = np.r_[0, np.cumsum(s)]
        at = [i for i, v in enumerate(s) if v > 0]
        segs = [(0, 0, c[at[b] + 1] - c[at[a]]) for a, b in toxicity.maximal_segments([c[i] for i in at], [c[i + 1] for i in at])]
        want = 1 / (1 + math.exp(-(model["a"] + model["b"] * toxicity.evidence(segs, len(s), model["lam"], model["k"]))))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-4) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


# 3 Mixing


def test_targets_reach_the_total_and_their_caps(spark):
    got = mixing.targets(spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 7)], "source string, source_size long")).collect()
    t = {r.source: r.target for r in got}
    assert sum(t.values()) == pytest.approx(1117)
    assert t["b"] == 30 and t["c"] > 0 and t["a"] == pytest.approx(266.5) and t[None] == 21


def test_mixing_odd_rows(spark, odd, none):
    p = mixing.plan(odd).collect()
    assert len(p) == 11 and all(r.taken <= 3 * r["size"] for r in p)
    assert sorted((r.doc_id or -1, r.taken) for r in p) == sorted((r.doc_id or -1, r.taken) for r in mixing.plan(odd.repartition(5)).collect())
    m = mixing.mix(odd)
    assert m.columns == odd.columns
    assert collections.Counter(r.doc_id for r in m.collect()) == collections.Counter({d: n for d, n in collections.Counter(x for r in mixing.plan(odd).collect() for x in [r.doc_id] * r.copies).items()})
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


# 4 SimHash


def brute_fingerprint(text):
    w = words(text)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, 6, dtype=np.uint64)[rng.integers(0, 6, 300)]
    for _ in range(seed + 1):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    x = np.unique(x)
    side = rng.integers(0, 2, len(x)) if seed % 2 else None
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    if side is not None:
        near &= side[:, None] != side[None]
    e = simhash.trie_join(x, 4, side, leaf=4)
    assert closure(len(x), np.argwhere(np.triu(near, 1))) == closure(len(x), e) and all(near[a, b] for a, b in e)


@pytest.mark.parametrize("params", [{}, {"per_bucket": 1, "max_bucket": 3}, {"per_bucket": 2, "max_bucket": 2}])
def test_components_with_small_buckets(spark, params):
    rng = random.Random(1)
    base = " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(400)).split()
    rows = []
    for i in range(60):
        w = list(base) if i % 3 else [rng.choice("klmn") + str(rng.randint(0, 999)) for _ in range(50)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((100 - i, " ".join(w)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **params).collect()}
    ids = sorted(d for d, _ in rows)
    fp = {d: brute_fingerprint(t) for d, t in rows}
    comp = closure(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 4])
    assert got == {d: (f"{fp[d]:016x}", ids[comp[i]]) for i, d in enumerate(ids)}


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 11
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {3, 4, 7} and {r.component_id for r in got if r.doc_id in zero} == {3}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    c = {r.doc_id: r.component_id for r in got}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({d or 0 for d in c if c[d] == d})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_null_and_repeated_ids_keep_unrelated_texts(spark):
    """Different texts under null or equal ids are rows of their own, and don't connect what is near each of them."""
    rng = random.Random(4)
    text = [" ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (7, text[4]), (5, text[0]), (900, text[1]), (None, text[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fp = [brute_fingerprint(t) for t in text]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fp) for b in fp[:i])
    least = {0: 5, 1: 900, 2: None, 3: 7, 4: 7, 5: None}
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect()]
    assert sorted(got, key=repr) == sorted(((i, f"{fp[text.index(t)]:016x}", least[text.index(t)]) for i, t in rows), key=repr)
    kept = [(r.doc_id, text.index(r.text)) for r in simhash.keep_first(d).collect()]
    assert sorted(kept, key=repr) == sorted(((least[k], k) for k in range(6)), key=repr)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {k: 100 for k in range(100, 140)} | {60: 40} | {40 + i: 40 for i in range(20)} if 60 in got else got == {i: i // 20 * 20 for i in range(60)} | {k: 100 for k in range(100, 140)}


# 5 Exact dedup


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    big = lambda d: math.inf if d is None else d
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for t, ids in groups.items():
        keep, left = min(ids, key=big), 1
        for d in ids:
            kept = d == keep and left > 0
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_dedup_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in exact_dedup.groups(odd, salts=3).collect()), key=repr)
    assert got == brute_dedup(rows)
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r[0] or 0 for r in got if r[3])
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_dedup_does_not_depend_on_row_order(spark):
    rows = [(1, "a  b", "p"), (1, "a b", "q"), (1, "a\tb", "r"), (1, "a b", "o"), (None, "c", "x"), (None, "c ", "y"), (None, "c", "w")] + [(2, "d", "e")] * 25
    kept = []
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string, tag string").repartition(3)
        kept.append(sorted((tuple(r) for r in exact_dedup.keep_first(df).collect()), key=repr))
        got = sorted((tuple(r) for r in exact_dedup.groups(df, salts=2).collect()), key=repr)
        assert got == brute_dedup([r[:2] for r in rows])
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 4 and (1, "a\tb", "r") in kept[0] and (None, "c", "w") in kept[0]
    parts = exact_dedup.copies_of(spark.createDataFrame([(25,), (10,), (1,)], "copies long"), step=10).collect()
    assert sorted((r.copies, r.i) for r in parts) == sorted((c, i) for c in (25, 10, 1) for i in range(1, c + 1))


def test_dedup_compares_contents_where_digests_collide(spark, monkeypatch):
    weak = lambda body: (F.substring(body, 1, 1).cast("binary"), F.length(body).cast("long"))
    monkeypatch.setattr(exact_dedup, "digests", weak)
    rows = [(i, t) for i, t in enumerate(["ab", "ac", "ab", "ad", "bb", "bcc", "ac", "bb", "zz"] * 3)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), salts=2).collect()}
    assert got == {d: (k, n) for d, k, n, _, _ in brute_dedup(rows)}


# 6 Decontamination


def test_myers_against_the_table():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randint(a, b))) for a, b in ((1, 40), (0, 60)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        got = decontam.best_end(decontam.masks(p), len(p), t, len(p))
        assert (got[0] if got else len(p)) == min(row)


def test_decontamination_finds_edits_within_budget(spark, odd, none):
    item = "a passage of the benchmark that is long enough to have an error budget of several edits in it"
    k = int(len(item) * 0.1)
    edit = lambda n: "".join("#" if i % 9 == 3 and i // 9 < n else c for i, c in enumerate(item))
    rows = [(1, f"before {item} after"), (2, f"BEFORE\n{item.upper()} after"), (3, edit(k) + " end"), (4, edit(k + 2)), (5, item[:40]), (6, None), (7, "")]
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "tiny"), (10, item)], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 10, 0), (2, 10, 0), (3, 10, k)}
    for chars in (1 << 20, 50):
        assert {(r.doc_id, r.item_id, r.errors) for r in decontam.find(d, bench, block_chars=chars).collect()} == want
        assert {r.doc_id for r in decontam.clean(d, bench, block_chars=chars).collect()} == {4, 5, 6, 7}
    assert decontam.clean(odd, bench).columns == odd.columns and decontam.clean(odd, bench).count() == 11
    assert decontam.find(none, bench).count() == 0 and decontam.find(d, bench.limit(0)).count() == 0


def edits_within(p, t):
    """The fewest edits between p and any part of t, by the table."""
    row = np.zeros(len(t) + 1, int)
    text = np.array(list(t))
    for i, c in enumerate(p, 1):
        new = np.minimum(np.r_[i, row[:-1] + (text != c)] if len(t) else np.array([i]), row + 1)
        new[0] = i
        row = np.minimum.accumulate(new - np.arange(len(t) + 1)) + np.arange(len(t) + 1)
    return int(row.min())


def test_matcher_against_the_table():
    """Nothing within the budget is missed and nothing beyond it found, whatever the edits and however alike the items."""
    r = random.Random(8)
    vocab = ["the", "then", "than", "rain", "train", "in", "an", "a", "stone", "tone"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(10, 40)))) for i in range(10)]
    m = decontam.Matcher(items, 0.1, 40, most_seen=50)
    found = 0
    for _ in range(120):
        t = list(r.choice(items)[1])
        for _ in range(r.randint(0, int(len(t) * 0.14))):
            at = r.randrange(len(t))
            t[at : at + r.choice([0, 1])] = r.choice(["", r.choice("aehinort "), "x"])
        line = decontam.simplified(" ".join(r.choice(vocab) for _ in range(r.randint(0, 30))) + " " + "".join(t) + " " + r.choice(vocab))
        want = {k: e for k, p in items if (e := edits_within(p, f" {line} ")) <= int(len(p) * 0.1)}
        got = {k: e for k, e, _ in m.hits(line)}
        assert got == want
        found += len(got)
    assert found > 60


def test_decontamination_query_against_all_windows(spark):
    bench = [(r.item_id, decontam.simplified(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text]
    got = collections.defaultdict(dict)
    for r in queries.op6_decontamination(spark, DATA).collect():
        got[r.doc_id][r.item_id] = r.errors
    seen, short = 0, sorted(docs(spark).where("length(text) < 3000").collect(), key=lambda r: (r.doc_id not in got, r.doc_id))
    for r in short[:20]:
        line = f" {decontam.simplified(r.text)} "
        want = {}
        for i, p in bench:
            k = int(len(p) * 0.1) if len(p) >= 40 else 0
            p = p if len(p) >= 40 else f" {p} "
            if (e := edits_within(p, line)) <= k:
                want[i] = e
        assert got.get(r.doc_id, {}) == want
        seen += len(want)
    assert seen and not all(r.doc_id in got for r in short[:20])


# 7 Language model


def brute_base(rows):
    tk = lambda t: [*words(t), "\0"]
    c = collections.Counter(w for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2 for w in tk(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, len(tk(t)), sum(c[w] > 0 for w in tk(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tk(t)), 4)) for d, t in rows), key=repr)


@pytest.mark.parametrize("params", [{}, {"block_tokens": 500, "shards": 3}])
def test_base_score_is_exact(spark, params):
    d = docs(spark)
    got = lm.scored(d, **params).collect()
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == brute_base(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_reads_counts_back():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    c = rng.integers(1, 1000, len(h))
    bits, least = lm.build_slice([(h, c), (h[:0], c[:0])], 9.0, 1 << 24, 5)
    stats = {"least": least, "once": int((c == 1).sum()), "token": [np.bincount(lm.count_levels(c), minlength=lm.LEVELS).tolist(), np.bincount(lm.count_levels(c), c, lm.LEVELS).tolist(), 0, 0], "pair": [[0] * lm.LEVELS, [0] * lm.LEVELS, 0, 0]}
    m = lm.Model([bits.tobytes()], [stats], 5)
    level = m.levels(h)
    assert (level >= lm.count_levels(c)).all() and (level == lm.count_levels(c)).mean() > 0.97  # never too low
    assert (m.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.03
    small, cut = lm.build_slice([(h, c), (h[:500], c[:500])], 9.0, 200_000, 5)
    assert 8 * len(small) <= 200_064 and max(cut) > 1


def test_filter_leaves_no_pair_out():
    """A shard's answers know every n-gram of every learning document, however many there are, and nothing is pruned."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 62, 120_000, dtype=np.uint64)
    before = np.r_[np.uint64(lm.BEGIN), h[:-1]]
    yes, dev = np.ones(len(h), bool), np.arange(len(h)) < 3000
    blobs = list(lm._asked(7, h, before, yes, dev, 1))
    t = lm.pa.table({"kind": [x[1] for x in blobs], "block": [x[2] for x in blobs], "blob": [x[3] for x in blobs]})
    got = {r["kind"]: r["blob"] for r in lm.reducer(1, 9.0, 5)((lm.pa.scalar(0),), t).to_pylist()}
    level, dev_level = lm.unpack(got[lm.PAIRS])
    assert len(level) == len(h) and (level > 0).all() and 117_000 <= (lm.unpack(got[lm.TOKENS])[1] > 0).sum()
    assert (dev_level > 0).sum() < 300  # dev pairs are only hidden from the slice that lambdas are learned by
    stats = lm.json.loads(got[lm.STATS])
    assert stats["least"] == [1, 1] and sum(stats["pair"][0]) == len(h) and sum(stats["rest"][0]) == len(h) - 3000


def test_lm_score_does_not_depend_on_the_blocks(spark):
    d = docs(spark)
    a, b = (sorted((r.doc_id, r.n_tokens, r.score) for r in lm.scored(d, **p).collect()) for p in ({"shards": 3}, {"shards": 3, "block_tokens": 300}))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], rel=1e-6)


def test_lm_score_against_brute_force(spark):
    """The model's scores with a filter that hardly errs, against counts and levels in plain Python."""
    d = docs(spark).where("length(text) < 4000")
    rows = [(r.doc_id, ["\n", *words(r.text), "\n\n"], r.dev == 0) for r in d.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit("dev")), F.lit(5)).alias("dev")).collect()]
    learns = [(t, dev) for i, t, dev in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t, _ in learns for w in t[1:])
    pairs, rest = (collections.Counter(p for t, dev in learns if not (part and dev) for p in zip(t, t[1:], strict=False)) for part in (False, True))
    n, v = sum(c.values()), len(c)
    level = lambda k: k.bit_length()

    def means(counts):
        by = collections.defaultdict(list)
        for k in counts.values():
            by[level(k)].append(k)
        return collections.defaultdict(float, {x: sum(ks) / len(ks) for x, ks in by.items()})

    mean, of_all, of_rest = means(c), means(pairs), means(rest)
    unseen = min(max(sum(k == 1 for k in c.values()) / n, 1 / (n + v + 1)), 0.5)

    def chances(before, w, counts, its):
        own, known = c[w], before == "\n" or c[before] > 0
        alone = (1 - unseen) * mean[level(own)] / n if own else unseen
        times = mean[level(len(learns))] if before == "\n" else mean[level(c[before])]
        pair = its[level(counts[before, w])] if own and known else 0.0
        return lm.LEVELS if before == "\n" else level(c[before]), min(pair / max(times, 1), 1.0), alone

    hist = np.zeros((lm.LEVELS + 1, len(lm.BINS)))
    for t, dev in learns:
        for p in zip(t, t[1:], strict=False) if dev else ():
            ahead, pair, alone = chances(*p, rest, of_rest)
            hist[ahead, int(np.clip(np.floor((np.log2(pair / alone) + 24) * 4), 0, len(lm.BINS) - 2)) + 1 if pair else 0] += 1
    lam = lm.learn_lambdas(hist)
    got = {r.doc_id: r.score for r in lm.scored(d, shards=3, bits_per_entry=300.0, dev_part=5).collect()}
    assert len(got) == len(rows) > 100 and hist.sum() > 1000
    for i, t, _ in rows:
        want = 0.0
        for p in zip(t, t[1:], strict=False):
            ahead, pair, alone = chances(*p, pairs, of_all)
            want += math.log10(lam[ahead] * pair + (1 - lam[ahead]) * alone)
        assert got[i] == pytest.approx(want, rel=2e-4)


def test_lm_odd_rows(spark, odd, none):
    got = lm.scored(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == brute_base(rows)
    assert all(r.score <= 0 for r in got)
    assert lm.scored(none).count() == 0
    nothing = odd.where("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 7) = 2")
    assert all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in lm.scored(nothing).collect())


# 9 Quality


def test_quality_held_out_and_odd_rows(spark, odd, none):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["blah$$", "###", "!!!x", "zz%%"]) if i % 5 == 0 else r.choice(["plain", "words", "of", "good", "prose", "here"]) for _ in range(30))) for i in range(400)]
    y = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.flag(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert len(got) > 60 and (got.predicted == got.quality).mean() > 0.97
    out = quality.flag(odd, y.unionByName(y)).collect()
    assert len(out) == 11 and all(0 <= x.score <= 1 for x in out)
    assert {x.score for x in quality.flag(odd, y.limit(0)).collect()} == {0.5}
    assert quality.flag(none, y).count() == 0
    assert any(r.score for r in quality.flag(odd, y.where("quality = 1")).collect())


def test_quality_query_against_brute_force(spark):
    """Every row of the query: the share of each feature times its contribution; forms by their definition."""
    m = quality.train(docs(spark), labels(spark))
    got = {r.doc_id: r for r in queries.op9_quality(spark, DATA).collect()}
    for r in docs(spark).collect():
        k, share = quality.bag(r.text, m["bits"], m["sizes"])
        z = m["intercept"] + float(share.astype(float) @ m["gain"][k].astype(float))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_forms_name_equal_words():
    rng = np.random.default_rng(0)
    row, word = np.sort(rng.integers(0, 4, 60)), rng.integers(0, 3, 60).astype(np.uint64)
    got = collections.Counter((int(a), int(b)) for rows, hs in quality.forms(row, word) for a, b in zip(rows, hs, strict=True))
    by = collections.defaultdict(set)
    for n in (2, 3, 4):
        for i in range(len(row) - n + 1):
            if row[i] == row[i + n - 1]:
                w = word[i : i + n].tolist()
                by[tuple(w.index(x) for x in w)].add(int(row[i]))
    one = {f: {h for rows, hs in quality.forms(np.zeros(len(f), int), np.array(f, np.uint64)) for h in hs.tolist()[:1]} for f in by}
    assert sum(got.values()) == sum(max(int((row == v).sum()) - n + 1, 0) for v in range(4) for n in (2, 3, 4))
    assert len({h for _, h in got}) == len(by) == len(set().union(*one.values()) & {h for _, h in got})
