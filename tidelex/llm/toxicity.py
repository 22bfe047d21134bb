"""Toxicity by maximum-scoring segments (operator 1).

Token scores are log-odds of words and word beginnings between toxic and clean labelled texts under an informative Dirichlet prior (the pooled
counts times prior_share), kept where they are significant, less a constant drift, so that clean text has a negative
mean. A linear scan finds all maximal-scoring segments of each text. Their scores follow an extreme-value law with
parameters lambda and K; a text's evidence is the sum of the log10 significance of its segments, and a logistic
curve on the labelled rows turns it into the score. lambda, K and the curve are cross-fitted: each half of the sample is scanned with
the log-odds of the other half, so that they don't rest on rows that chose the tokens.

Defined results: null and empty texts, and texts without a toxic passage, get the curve's value at no evidence. With
no labels, or labels of one class, or of texts of one class only, the score is the share of toxic labels (0 without any) for all texts. Repeated
rows are scored each for itself. Columns of the input stay; the operator's own names are free to clash (they get
underscores). Memory: chunks of 1 MB and the toxic tokens of one text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, free_name, labelled_sample, written
from .textvec import word_features

BUCKET_BITS = 20
#: Bytes of the word beginnings that count as features beside the word, as toxic stems take many endings.
PREFIXES = (4, 5, 6, 7)
SEGMENT = "array<struct<first_token:long,last_token:long,score:double,log10_e:double>>"


def maximal_segments(left: list[float], right: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments, as (first, last) of the given positive tokens. left and right: the running sum
    of all scores before and after each positive token. Each token is pushed and merged once: linear time."""
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest entry below with a smaller sum before
    for k, (lo, hi) in enumerate(zip(left, right, strict=True)):
        first = k
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= lo:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= hi:
                stack.append((lo, hi, first, k, j))
                break
            lo, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[2], s[3]) for s in stack]


def feature_scores(toxic: np.ndarray, clean: np.ndarray, prior_share: float = 0.1, z_min: float = 3.0, delta_min: float = 2.0) -> np.ndarray:
    """The significant and large log-odds of each feature bucket, 0 elsewhere."""
    n1, n0 = float(toxic.sum()), float(clean.sum())
    both = (toxic + clean).astype(float)
    a0 = max(prior_share * (n1 + n0), 1.0)
    a = np.maximum(a0 * both / max(n1 + n0, 1.0), 1e-9)
    y1, y0 = toxic + a, clean + a
    delta = np.log(y1 / np.maximum(n1 + a0 - y1, 1e-9)) - np.log(y0 / np.maximum(n0 + a0 - y0, 1e-9))
    z = delta / np.sqrt(1 / y1 + 1 / y0)
    return np.where((both > 0) & (z >= z_min) & (delta >= delta_min), delta, 0.0)


def solve_lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * score)) = 1; the mean score must be negative."""

    def excess(lam: float) -> float:
        return float(p @ np.exp(np.minimum(lam * scores, 700.0))) - 1

    lo, hi = 1e-6, 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, half) -> (bucket, half, toxic, clean) counts of a task."""
    got = np.zeros((2, 2, 1 << BUCKET_BITS), np.int32)
    for b in batches:
        label, half = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (1, 2))
        for rows, hashes, has in word_features(b.column(0), PREFIXES):
            y, part = label[rows], half[rows]
            for h, ok in zip(hashes, has, strict=True):
                np.add.at(got, (part[ok], y[ok], _buckets(h[ok])), 1)
    for part in (0, 1):
        at = np.flatnonzero(got[part].any(axis=0))
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), part)), pa.array(got[part, 1, k].astype(np.int64)), pa.array(got[part, 0, k].astype(np.int64))], ["k", "half", "toxic", "clean"])


def scan(column: pa.Array, scores: np.ndarray, drift: float) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]], dict[int, list[float]]]:
    """(tokens of each row, maximal segments of the rows that have any: first and last token, score, and these rows'
    positive token scores). A token scores as its best feature, less the drift."""
    n = np.zeros(len(column), np.int64)
    found: dict[int, list] = {}
    total = 0.0
    for rows, hashes, has in word_features(column, PREFIXES):
        if not len(rows):
            continue
        s = np.zeros(len(rows))
        for h, ok in zip(hashes, has, strict=True):
            np.maximum(s, scores[_buckets(h)] * ok, out=s)
        s -= drift
        after = total + np.cumsum(s)
        new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        begin = np.repeat(new, np.diff(np.r_[new, len(rows)]))
        base = n[rows]
        for i in np.flatnonzero(s > 0).tolist():
            found.setdefault(int(rows[i]), []).append((int(base[i] + i - begin[i]), float(after[i] - s[i]), float(after[i])))
        n += np.bincount(rows, minlength=len(n))
        total = float(after[-1])
    out, plus = {}, {}
    for row, hits in found.items():
        left, right = [x[1] for x in hits], [x[2] for x in hits]
        out[row] = [(hits[a][0], hits[b][0], right[b] - left[a]) for a, b in maximal_segments(left, right)]
        plus[row] = [x[2] - x[1] for x in hits]
    return n, out, plus


def log10_e(score: float, tokens_: int, lam: float, k: float) -> float:
    """log10 of the expected number of segments of that score or more in clean text of that length."""
    return (np.log(max(k * tokens_, 1e-300)) - lam * score) / np.log(10)


def evidence(segments: list[tuple[int, int, float]], n: int, lam: float, k: float) -> float:
    return sum(max(0.0, -log10_e(s, n, lam, k)) for _, _, s in segments)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on one variable by Newton steps with a small ridge; the slope isn't negative."""
    b = np.zeros(2)
    m = np.c_[np.ones(len(x)), x]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
        g = m.T @ (w * (y - p)) - 1e-3 * b
        step = np.linalg.solve((m * (w * p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), g)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = 16_000, prior_share: float = 0.1, z_min: float = 3.0, delta_min: float = 2.0, drift: float = 0.1) -> dict:
    """The model, from at most max_train_rows labelled rows (half of each class), of which whole texts are read.
    What is broadcast and collected is bounded by max_train_rows, their toxic passages and the number of buckets."""
    ids, sizes = labelled_sample(docs, labels, "toxic", max_train_rows // 2)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    model = {"scores": None, "drift": drift, "lam": 1.0, "k": 1.0, "a": 0.0, "b": 0.0, "prior": n1 / (n0 + n1) if n0 + n1 else 0.0}
    if not n0 or not n1:
        return model
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = written(rows.select("text", "y", half.alias("half")), "sample")  # read twice from here on, not from all documents
    got = rows.mapInArrow(_counts, "k long, half long, toxic long, clean long").groupBy("k", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    n = np.zeros((2, 2, 1 << BUCKET_BITS))
    k, part = got.column("k").to_numpy(), got.column("half").to_numpy()
    n[part, 1, k], n[part, 0, k] = got.column("toxic").to_numpy(), got.column("clean").to_numpy()
    whole = feature_scores(*n.sum(axis=0)[::-1], prior_share, z_min, delta_min).astype(np.float32)
    # What each half is scanned with is learned on the other.
    across = np.stack([feature_scores(n[1 - v, 1], n[1 - v, 0], prior_share, z_min, delta_min) for v in (0, 1)]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(across)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By row: its label, tokens and segment scores; and by task the clean and toxic rows' positive token scores with their counts."""
        plus: Counter = Counter()
        names = ["y", "n", "s", "score", "times"]
        lists, no = pa.list_(pa.float64()), lambda m, t: pa.nulls(m, t)
        for b in batches:
            label, part = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (1, 2))
            for v in (0, 1):
                mine = np.flatnonzero(part == v)
                n, found, hits = scan(b.column(0).take(pa.array(mine)), shared.value[v], drift)
                for i, scores in hits.items():
                    plus.update((int(label[mine[i]]), round(x, 3)) for x in scores)
                yield pa.RecordBatch.from_arrays([pa.array(label[mine], pa.int32()), pa.array(n), pa.array([[x[2] for x in found.get(i, ())] for i in range(len(n))], lists), no(len(n), pa.float64()), no(len(n), pa.int64())], names)
        if plus:
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in plus], pa.int32()), no(len(plus), pa.int64()), no(len(plus), lists), pa.array([x for _, x in plus], pa.float64()), pa.array(list(plus.values()), pa.int64())], names)

    out = written(rows.mapInArrow(segments, "y int, n long, s array<double>, score double, times long"), "segments")
    each = out.where("n is not null").select("y", "n", "s").collect()
    plus = [(r["y"], r["score"], r["times"]) for r in out.where("n is null").groupBy("y", "score").agg(F.sum("times").alias("times")).collect()]
    n_clean = max(sum(r["n"] for r in each if r["y"] == 0), 1)
    seen = {v: sum(t for y, _, t in plus if y == v) for v in (0, 1)}
    # The clean law of token scores; toxic tokens count a little there, as none may have been seen in clean text.
    values = np.array([x for _, x, _ in plus] + [-drift])
    p0 = np.array([t / (seen[1] if y else 1) for y, _, t in plus] + [n_clean - seen[0]], float)
    lam = solve_lambda(values, p0 / p0.sum())
    toxic_scores = np.repeat([x for y, x, _ in plus if y], [t for y, _, t in plus if y])
    one = np.sort(np.r_[[x for r in each if r["y"] == 0 for x in r["s"]], np.median(toxic_scores) if len(toxic_scores) else 1.0])
    # Half of the clean segments score their median or more: K follows from that count.
    k = (len(one) / 2) * float(np.exp(min(lam * one[len(one) // 2], 600.0))) / n_clean
    x = np.array([evidence([(0, 0, v) for v in r["s"]], r["n"], lam, k) for r in each])
    y = np.array([r["y"] for r in each], float)
    w = np.where(y > 0, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    a, b = _logistic(x, y, w * len(y) / w.sum()) if 0 < y.sum() < len(y) else (float(np.log(n1 / n0)), 0.0)
    return model | {"scores": whole, "lam": lam, "k": k, "a": a, "b": b}


def score(df: DataFrame, model: dict, text: str = "text", score_col: str = "score", segments_col: str = "segments") -> DataFrame:
    """df with the score of each row's whole text and its toxic passages (token positions, significance)."""
    score_col = free_name(df, score_col)
    segments_col = free_name(df, segments_col, score_col)
    schema = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(segments_col, T._parse_datatype_string(SEGMENT))])
    at, kind = df.columns.index(text), pa.list_(pa.struct([("first_token", pa.int64()), ("last_token", pa.int64()), ("score", pa.float64()), ("log10_e", pa.float64())]))
    names = schema.names
    small = {k: v for k, v in model.items() if k != "scores"}
    if model["scores"] is None:
        return df.withColumns({score_col: F.lit(float(model["prior"])), segments_col: F.array().cast(SEGMENT)})
    shared = df.sparkSession.sparkContext.broadcast(model["scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lam, k = small["lam"], small["k"]
        for b in batches:
            n, found, _ = scan(b.column(at), shared.value, small["drift"])
            x = np.zeros(len(n))
            spans: list[list] = [[]] * len(n)
            for i, segs in found.items():
                e = [log10_e(v, int(n[i]), lam, k) for _, _, v in segs]
                x[i] = evidence(segs, int(n[i]), lam, k)
                spans[i] = [{"first_token": f, "last_token": t, "score": v, "log10_e": z} for (f, t, v), z in zip(segs, e, strict=True) if z < 0]
            p = 1 / (1 + np.exp(-np.clip(small["a"] + small["b"] * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(spans, kind)], names)

    return df.mapInArrow(run, schema)


def flag(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and the passages found."""
    model = train(docs, labels, **params)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(rows, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")


def remove(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    model = train(docs, labels, **params)
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = score(rows, model, text=f"c{docs.columns.index('text')}", score_col="p", segments_col="s").where(F.col("p") < threshold)
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
