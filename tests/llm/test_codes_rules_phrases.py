"""Operators 11 to 13 against plain Python versions, and their defined results for odd tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import DATA
from tidelex.llm import codes, phrases, queries, rules

VECTORS = "vec_id long, embedding array<float>, label int, code string, q string"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows of (vec_id, vector, label) in whole numbers' source form -> ({vec_id: (code, error, label error)}, digest)."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = [(i, y, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, y in kept]
    by = Counter()
    for _, y, m in out:
        by[y] += sum(d for d, _ in m)
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in m), sum(d for d, _ in m), by[y]) for i, y, m in out), hashlib.sha256(text.encode()).hexdigest()


def got_codes(out):
    rows = out.collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), int(i) % 3) for i in rng.permutation(60)]
    rows += [(7, rows[0][1], None), (7, rows[0][1], None), (None, rows[1][1], 1), (61, None, 1), (62, [None] + [0.0] * 15, 1), (63, [float("nan")] + [0.0] * 15, 1), (64, [float("-inf")] + [0.0] * 15, None)]
    return rows + [(70 + i, [0.25] * 16, None) for i in range(9)] + [(80, [-0.0001] * 16, 2)]


def test_codes_against_plain_python(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    want, digest = brute_codes(rows)
    for order in (df, df.orderBy("vec_id").repartition(7), df.coalesce(1)):
        got, digests = got_codes(codes.by_label(*codes.compress(order)))
        assert got == want and digests == {digest}
    few, digest = brute_codes(rows[:5], parts=4, rounds=2)
    got, digests = got_codes(codes.by_label(*codes.compress(df.limit(5).where("vec_id is not null"), parts=4, rounds=2)))
    assert got == few and digests == {digest}


def test_codes_of_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got, digests = got_codes(queries.op11_codes(spark, DATA))
    want, digest = brute_codes(rows)
    assert got == want and digests == {digest}


def test_codes_of_odd_widths_and_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codes.by_label(*codes.compress(none)).collect() == []
    rows = [(i, [float(i)] * 8, 1) for i in range(5)] + [(9, [1.0] * 4, 1), (10, [], 1), (11, None, 1)]
    out = {r.vec_id: r for r in codes.by_label(*codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 9, 10} and out[9].code is None and out[10].error is None and out[4].error == 0 and out[9].label_error == 0
    same = spark.createDataFrame([(1, [1.0] * 6, 1), (2, [2.0] * 6, 1)], "vec_id long, embedding array<double>, label int")
    assert [r.code for r in codes.by_label(*codes.compress(same)).collect()] == [None, None]
    with pytest.raises(ValueError, match="below"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int"))


def test_distances_are_exact_at_the_limit():
    rng = np.random.default_rng(1)
    x = rng.integers(-codes.LIMIT + 1, codes.LIMIT, (50, 16))
    book = rng.integers(-codes.LIMIT + 1, codes.LIMIT, (16, 16))
    book[3] = book[9] = x[0]
    x[1], book[5] = codes.LIMIT - 1, 1 - codes.LIMIT
    at, d = codes.nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)), e) for e, c in enumerate(book)) for r in x]
    assert [(int(b), int(a)) for a, b in zip(at, d, strict=True)] == want and at[0] == 3


# Rules ---------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("ab \t\n\x0b#|é😀A."), max_size=80))
def test_counts_against_plain_python(text):
    assert rules.counts(text)[:5] == brute_counts(text)


def test_windows_that_overlap_themselves():
    assert rules.counts("a " * 6)[4] == 6 and rules.counts("a " * 5)[4] == 0 and rules.counts("a b c d e x a b c d e")[4] == 10
    assert rules.counts("x\ny\nx \nx\n\n\n")[3] == 1
    long = " ".join(f"w{i}" for i in range(30_000))
    assert rules.counts(long)[4] == 0 and rules.counts(f"{long} {long}")[4] == 60_000


def test_rules_query_and_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    out = {r.doc_id: r for r in queries.op12_rules(spark, DATA).collect()}
    assert len(out) == len(docs)
    for d in docs:
        r, n = out[d.doc_id], brute_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_forest_sets_odd_statistics_apart(spark):
    """On rows it hasn't seen: what is like nothing in the good rows goes, all but a few good rows stay, at every size of the sample."""
    folder = DATA.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = queries.op12_rules(spark, folder).join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2").toPandas()
    judged = out[~out.base_failed]
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.985 and bad.kept.mean() < 0.25 and len(bad) > 30


def test_rules_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (2, 1, 0), (5, 0, 0), (None, 1, 0), (99, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = rules.judge(odd, some).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
        assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
        assert {r.n_repeat_words for r in rows if r.doc_id == 5} == {40_000}
    assert rules.judge(none, labels).collect() == []


def test_every_good_row_alike(spark):
    """No statistic varies: no split can be made, nothing is anomalous."""
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert rules.judge(docs, labels).where("not kept").count() == 0


# Phrases -------------------------------------------------------------------------------------------------------------


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, least=10, most=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        for w in pieces(text):
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    for key, n in f.items():
        if len(key) == 2:
            total[key[0]] += n
    found = {k: n for k, n in f.items() if len(k) > 2 and n >= least}
    out = []
    for (lang, *w), a in found.items():
        if any(100 * b >= 50 * a for (x, *v), b in found.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, score, a, " ".join(w), left, right, total[lang]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    rank = Counter()
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= most:
            yield (r[0], rank[r[0]], r[3], r[2], r[4], r[5], r[6], r[1])


TEXT = st.text(st.sampled_from("aAbé \t\n\x0b.,!"), max_size=60)


@settings(deadline=None, max_examples=100)
@given(st.lists(TEXT, max_size=5), st.sampled_from([1, 5, 1 << 20]))
def test_phrases_of_shards_are_those_of_pieces(texts, limit):
    body = b"\n".join(b for t in texts if (b := phrases.normal(t)) != b"  ")
    got = Counter(buf[i:j].tobytes().decode() for buf, _, a, b, _, new in phrases.phrases(body, 1, limit) for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True))
    want = Counter(" ".join(w[i : i + k]) for t in texts for w in pieces(t) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want
    if want:
        assert phrases.matches(want, body.decode()) == want


@pytest.mark.parametrize("bits,shard", [(28, 8 << 20), (16, 500), (11, 1)])
def test_phrases_against_plain_python(spark, odd, bits, shard):
    """Neither a sketch full of collisions nor small shards change a count."""
    more = [("en", "New  York, new york city!\nNEW york") , ("und", "a a a a b"), (None, "a a a a b. a a"), ("es", "de la de la de la")] * 6
    rows = [(r.lang, r.text) for r in odd.collect()] + more
    docs = odd.select("lang", "text", "score").unionByName(spark.createDataFrame([(*r, "s") for r in more], "lang string, text string, score string"))
    got = sorted(map(tuple, phrases.mine(docs, bits=bits, shard_bytes=shard).collect()))
    assert got == sorted(brute_phrases(rows)) and {r[0] for r in got} >= {"und", "en", "es"}
    two = sorted(map(tuple, phrases.mine(docs, bits=bits, shard_bytes=shard, most=2).collect()))
    assert two == sorted(brute_phrases(rows, most=2))


def test_phrases_of_no_rows(spark, none):
    assert phrases.mine(none).collect() == []
    assert phrases.mine(spark.createDataFrame([(None, None), ("en", " .. ")], "lang string, text string")).collect() == []


def test_scores_of_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    a, l, r = 10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 3
    rows = [("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "", 0, 10**13)]
    got = phrases.scores(spark.createDataFrame(rows, phrases.COUNTED), 10, 50).first()
    assert got.score == 1_000_000 * a * a // (l * r) and got.n == 10**13


def test_blocks_are_small_and_give_counts_back():
    """What shards send: counts and cells come back as they were, in a fraction of the bytes of plain rows."""
    rng = np.random.default_rng(1)
    names = {" ".join(f"w{i}" for i in rng.integers(0, 2000, k)) for k in rng.integers(1, 4, 40_000)} | {"", "naïve 😀"}
    found = {x: int(n) for x, n in zip(names, rng.integers(1, 30, len(names)), strict=True)} | {"": 2**32 - 1}
    sent = phrases.blocks("en", found, {x: i % 256 for i, x in enumerate(found)})
    back = [r for b in phrases.opened(iter([sent]), rows=1000) for r in b.to_pylist()]
    assert len(back) == len(found) and {r["phrase"]: r["n"] for r in back} == found and {r["lang"] for r in back} == {"en"}
    assert sent.nbytes < 0.5 * sum(len(x.encode()) + 8 for x in found)
    steps = np.diff(np.unique(rng.integers(0, 1 << 28, 1_000_000)), prepend=0).astype(np.uint32)
    block = phrases.packed(phrases.by_byte(steps))
    assert (phrases.from_bytes(phrases.unpacked(block)) == steps).all() and len(block) < 2 * len(steps)
