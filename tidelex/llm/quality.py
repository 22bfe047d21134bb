"""Quality classifier by supervised subword embeddings (operator 9).

A text is the average of the learned vectors of its features: hashed words, hashed pairs of words that follow each other, hashed
forms of word n-grams (which of their words are equal, whatever the words) and hashed character n-grams within words (whitespace marks a word's border); a softmax layer on top gives the class. Workers turn at most
max_train_rows labelled rows, whole texts of them, into bags of features, and the driver trains vectors and layer together by
stochastic gradient descent in numpy. As the layer is linear in the average, the workers get just each feature's contribution to the
logit, 2**bits floats.

Class sizes in the sample are balanced; the intercept is moved back to the classes' shares among all labels.

Defined results: null and empty texts have no features and get the intercept. With no labels, or of one class only,
the score is the share of label 1 (1/2 without any). Repeated rows are scored each for itself; extra columns are ignored.
Memory: chunks of 1 MB; on the driver the bags, of at most 2**bits features each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, written
from .textvec import char_grams, chunks, code_points, hashes, mix, token_bounds, utf8

PAIR = np.uint64(0xD6E8FEB86659FD93)
FORM = np.uint64(0xA0761D6478BD642F)

def features(column: pa.Array, bits: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all words, word pairs, forms and n-grams, by chunk."""
    mask = np.uint64((1 << bits) - 1)
    for buf, first, rows, _ in chunks(*utf8(column)):
        starts, ends = token_bounds(buf, first)
        word, row = hashes(buf, starts, ends), rows[np.searchsorted(first, starts, "right") - 1]
        yield row, (word & mask).astype(np.int64)
        near = row[1:] == row[:-1]
        yield row[1:][near], (mix(word[:-1][near] * PAIR + word[1:][near]) & mask).astype(np.int64)
        yield from ((r, (h & mask).astype(np.int64)) for r, h in forms(row, word))
        chars, at = code_points(buf, first)
        for _, start, h in char_grams(chars, at, sizes):
            yield rows[np.searchsorted(at, start, "right") - 1], (h & mask).astype(np.int64)


def forms(row: np.ndarray, word: np.ndarray, sizes: tuple[int, ...] = (2, 3, 4)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the word n-grams with names in the place of words: which of their words are equal, as "a b a"."""
    for n in sizes:
        m = max(len(word) - n + 1, 0)
        code, whole = np.full(m, n, np.uint64), row[n - 1 :] == row[:m]
        for i in range(1, n):
            name = np.full(m, i, np.uint64)  # the first place of the same word
            for j in range(i - 1, -1, -1):
                name[word[i : i + m] == word[j : j + m]] = j
            code = code * np.uint64(n + 1) + name
        yield row[:m][whole], mix(code[whole] + FORM)


def bag(text: str | None, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(its features, the share of each in the text)."""
    ks = [k for _, k in features(pa.array([text], pa.string()), bits, sizes)]
    k, n = np.unique(np.concatenate(ks) if ks else np.zeros(0, np.int64), return_counts=True)
    return k.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)


def margins(column: pa.Array, gain: np.ndarray, intercept: float, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    total, n = np.zeros(len(column)), np.zeros(len(column))
    for rows, k in features(column, bits, sizes):
        total += np.bincount(rows, gain[k], minlength=len(total))
        n += np.bincount(rows, minlength=len(n))
    return intercept + total / np.maximum(n, 1)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """(contribution of each feature to the logit of class 1, intercept), by gradient steps one text at a time."""
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            k, share = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = share @ v[k] if len(k) else np.zeros(dim, np.float32)
            z = w @ h + b
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[int(y[i])] -= 1
            back = g @ w
            w -= lr * np.outer(g, h)
            b -= lr * 0.1 * g
            if len(k):
                # As in averaged bags each feature gets the whole gradient, by its share of the text against an even one.
                v[k] -= (lr * len(k) * share)[:, None].clip(0, 4 * lr) * back
    gap = w[1] - w[0]
    return (v @ gap).astype(np.float32), float(b[1] - b[0])


def train(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = 3000, bits: int = 18, sizes: tuple[int, ...] = (3, 4, 5), dim: int = 8, epochs: int = 5, rate: float = 0.3, seed: int = 1) -> dict:
    ids, count = labelled_sample(docs, labels, "quality", max_train_rows // 2)
    n0, n1 = count.get(0, 0), count.get(1, 0)
    model = {"gain": None, "bits": bits, "sizes": sizes, "intercept": 0.0, "prior": n1 / (n0 + n1) if n0 + n1 else 0.5}
    if not n0 or not n1:
        return model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bag(t.as_py(), bits, sizes) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k for k, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float32()))], ["doc_id", "y", "k", "share"])

    kept = written(rows.mapInArrow(bagged, "doc_id long, y int, k array<int>, share array<float>"), "bags").toArrow()
    of = lambda name: [np.asarray(x.values) for x in kept.column(name)]
    bags, ids, label = list(zip(of("k"), of("share"), strict=True)), kept.column("doc_id").to_pylist(), kept.column("y").to_pylist()
    order = sorted(range(len(bags)), key=lambda i: (ids[i], label[i], bags[i][0].tobytes(), bags[i][1].tobytes()))
    y = np.array([label[i] for i in order], int)
    if not len(y) or y.min() == y.max():
        return model
    gain, intercept = fit([bags[i] for i in order], y, bits, dim, epochs, rate, seed)
    shift = np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum()))
    return model | {"gain": gain, "intercept": intercept + float(shift)}


def flag(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, **params)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model["gain"] is None:
        scored = rows.select("doc_id", F.lit(float(model["prior"])).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                z = margins(b.column(1), m["gain"], m["intercept"], m["bits"], m["sizes"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

        scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
