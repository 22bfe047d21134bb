"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path (operator 8).

Host and path are cut out by Spark expressions; of the rules that fit (host or a subdomain of it, and the beginning of
the path) the longest decides. Other URLs get the verdict of the model: n-grams of host and of path, each in its
own half of a fixed table of weights, which the driver trains with numpy from a small labelled URL table. What is broadcast
is the table of weights, 2**bits floats.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is judged by the model
like any other (an empty one by its intercept). A label table with one class only, or none, gives that class (or allow).
Repeated rows are judged each for itself."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .textvec import char_grams, chunks, code_points, utf8

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Words that the default label table is made of.
BAD = (
    "adult", "bet", "bingo", "bonus", "buy-now", "cams", "cash", "casino", "cheap", "click-bait", "crack", "crypto-win", "dating", "diet", "discount", "escort", "fast-money", "free-bets", "free-money", "gambling",
    "hot-girls", "instant-loan", "jackpot", "keygen", "loans", "lottery", "miracle", "nude", "payday", "pills", "poker", "porn", "prizes", "replica", "sexy", "slots", "spam", "torrent", "viagra", "warez", "watches", "win", "xxx",
)
GOOD = (
    "about", "academy", "archive", "art", "article", "blog", "book", "city", "college", "contact", "courses", "culture", "docs", "energy", "family", "film", "forum", "garden", "guide", "health", "help", "history", "home", "index",
    "journal", "kitchen", "lesson", "library", "local", "map", "market", "museum", "music", "news", "notes", "ocean", "paper", "park", "people", "photo", "press", "project", "recipes", "report", "school", "science", "sport",
    "story", "studio", "team", "theatre", "travel", "tutorial", "university", "weather", "wiki", "world",
)


def default_labels(n: int = 3000, seed: int = 7) -> list[tuple[str, int]]:
    """A small labelled URL table, (url, 1 to block or 0 to allow), by a rule: bad hosts and paths join words of which one at least is bad, good
    ones join good words or made-up names, so that unknown names weigh towards allow."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(2, 4))) + r.choice(["", "n", "s", "t"])
    rows = []
    for i in range(n):
        bad = i % 2
        words = [r.choice(BAD if bad and (k == 0 or r.random() < 0.5) else GOOD) if bad or r.random() < 0.6 else name() for k in range(2)]
        r.shuffle(words)
        host = r.choice(["", "", "www.", "m.", "blog."]) + r.choice(["-", "", "."]).join(words) + r.choice([".example", ".site", ""]) + r.choice([".com", ".net", ".org", ".info"])
        path = "/".join([r.choice(["en", "de", "es", "fr"])] * r.randint(0, 1) + [r.choice(BAD if bad and r.random() < 0.3 else GOOD) if r.random() < 0.6 else str(r.randint(1, 9999))])
        rows.append((f"http{r.choice(['', 's'])}://{host}/{path}" + r.choice(["", "/", ".html"]), bad))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: pa.Array, path: pa.Array, bits: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all n-grams; "^" and "$" mark the ends of host and path."""
    half = 1 << (bits - 1)
    for k, column in enumerate((host, path)):
        texts = pa.array([f"^{t}$" for t in column.to_pylist()], pa.string())
        for buf, first, rows, _ in chunks(*utf8(texts)):
            chars, at = code_points(buf, first)
            for _, start, h in char_grams(chars, at, sizes, within_words=False):
                yield rows[np.searchsorted(at, start, "right") - 1], (h & np.uint64(half - 1)).astype(np.int64) + k * half


def margins(host: pa.Array, path: pa.Array, weights: np.ndarray, intercept: float, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    total, n = np.zeros(len(host)), np.zeros(len(host))
    for rows, k in grams(host, path, bits, sizes):
        total += np.bincount(rows, weights[k], minlength=len(total))
        n += np.bincount(rows, minlength=len(n))
    return intercept + total / np.sqrt(np.maximum(n, 1))


def train(labels: list[tuple[str, str, int]], bits: int = 18, sizes: tuple[int, ...] = (3, 4, 5), epochs: int = 600, rate: float = 2.0, l2: float = 1e-3) -> dict:
    """Full-batch gradient steps on labels (host, path, 1 to block)."""
    y = np.array([v for *_, v in labels], float)
    model = {"bits": bits, "sizes": sizes, "weights": np.zeros(1 << bits, np.float32), "intercept": 0.0}
    if not len(y) or y.min() == y.max():
        return model | {"intercept": -10.0 if not len(y) or y[0] == 0 else 10.0}
    parts = list(grams(pa.array([h for h, *_ in labels]), pa.array([p for _, p, _ in labels]), bits, sizes))
    row, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    own, k = np.unique(k, return_inverse=True)
    x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))[row]
    w, b = np.zeros(len(own)), 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, x * w[k], minlength=len(y)))))
        g = (p - y) / len(y)
        w -= rate * 20 * (np.bincount(k, x * g[row], minlength=len(own)) + l2 * w / len(y))
        b -= rate * g.sum()
    weights = model["weights"].copy()
    weights[own] = w
    return model | {"weights": weights, "intercept": float(b)}


def judge(pages: DataFrame, labels: DataFrame | list[tuple[str, int]] | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.6, max_labels: int = 20_000, **params) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the model's score (chance of block; computed for all rows). labels(url, y), a table or
    rows, of which at most max_labels by a hash are learned from; the default table is made by a rule."""
    spark = pages.sparkSession
    table = labels if isinstance(labels, DataFrame) else spark.createDataFrame(default_labels() if labels is None else labels, "url string, y int")
    host, path = host_and_path(F.col("url").cast("string"))
    known = table.select(host.alias("h"), path.alias("p"), F.col("y").cast("int").alias("y")).where("y is not null")
    model = train([(r["h"], r["p"], r["y"]) for r in known.orderBy(F.xxhash64("h", "p", "y"), "h", "p", "y").limit(max_labels).collect()], **params)
    shared = spark.sparkContext.broadcast(model)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = margins(b.column(1), b.column(2), m["weights"], m["intercept"], m["bits"], m["sizes"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["page_id", "host", "path", "score"])

    scored = rows.mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
