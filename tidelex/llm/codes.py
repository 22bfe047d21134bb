"""Vector code compression by product codebooks in whole numbers (operator 11).

Components become integers, vectors are cut into parts, and each part position has a codebook of its own, which rounds of assignment and
averaging move. Each round sends the codebooks (parts x entries x components: some thousand numbers) to the workers, whose Arrow batches get all
squared distances by |x|^2 - 2 x.c + |c|^2 with int64 matrix products, take the first least one, and sum vectors by entry; a grouped
shuffle adds these sums of all tasks. All arithmetic is exact: int64 wraps around at most on the way, as components beyond LIMIT are refused, and
sums over tasks are decimals.

Defined results: rows whose vector is null or holds a null or a number that isn't finite are dropped. The width is that of most kept rows (of equally
many, the smaller); rows of another width, and all rows where parts don't divide it, stay without code and error, as do empty vectors. Codebooks start from the
smallest ids, null ids last, repeated ids in the order of their vectors; fewer rows than entries give fewer entries. Repeated rows are coded each for
itself. Null labels count as one label. An empty table gives an empty one. Extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components are to be smaller: then a squared distance of 16 components is below 2**63.
LIMIT = 1 << 28
SLICE = 4096


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q) of the rows that are kept."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("x")).where(F.col("x").isNotNull() & fine)
    return kept.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * float(scale))).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each row, by norm expansion in int64; the lower index of equally near ones."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, entries, components) sums and (parts, entries) counts of the vectors nearest to each entry."""
    parts, entries, long = books.shape
    total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    for b in batches:
        q = matrix(b.column(0), parts * long)
        for i in range(0, len(q), SLICE):
            for p in range(parts):
                x = q[i : i + SLICE, p * long : (p + 1) * long]
                at, _ = nearest(x, books[p])
                np.add.at(total[p], at, x)
                n[p] += np.bincount(at, minlength=entries)
    return total, n


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the mean, rounded down, of the parts nearest to it; unused ones stay. vectors(q)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = sums(batches, shared.value)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    each = vectors.mapInArrow(run, "part long, entry long, n long, total array<long>")
    by = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i].cast("decimal(28,0)")) for i in range(books.shape[2])]).alias("total"))
    new = books.copy()
    for r in by.collect():  # parts x entries rows
        new[r["part"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return new


def train(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, components) after the rounds."""
    first = [r["q"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = moved(vectors.select("q"), books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """rows(vec_id, embedding, label) -> ((vec_id, label, code, error) of the kept rows, codebooks). code: a byte as two hex digits for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    kept = written(whole_numbers(rows, scale), "vectors")
    seen = kept.groupBy(F.size("q").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most"))
    usual = seen.orderBy(F.desc("n"), "width").first()
    width = usual["width"] if usual else 0
    fits = width > 0 and width % parts == 0
    if fits and usual["most"] >= LIMIT * 16 // max(16, width // parts):
        raise ValueError(f"components must stay below {LIMIT // scale} in size for exact distances")
    mine = F.size("q") == F.lit(width)
    books = train(kept.where(mine), width, parts, entries, rounds) if fits else np.zeros((parts, 0, 0), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(2), width)
            code, error = np.zeros((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
            for i in range(0, len(q), SLICE):
                for p, book in enumerate(shared.value):
                    code[i : i + SLICE, p], d = nearest(q[i : i + SLICE, p * book.shape[1] : (p + 1) * book.shape[1]], book)
                    error[i : i + SLICE] += d
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = "vec_id long, label int, code string, error long"
    none = kept.where(~mine if fits else F.lit(True)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return (kept.where(mine).mapInArrow(run, schema).unionAll(none) if fits else none), books


def by_label(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The contract's columns: coded rows with the error of all rows of their label, and the codebooks' digest."""
    coded = written(coded, "codes")
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(total, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
