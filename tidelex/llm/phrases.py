"""Phrase collocation mining (operator 13).

Words and phrases of two and three words are counted by language in three steps. (1) A sketch: every one of them adds to a cell that its hash
names, so a cell's sum is never below the count of anything in it. Shards of texts send their cells, cut off at the least count, by ranges of
cells; each range gives one bit a cell: whether its sum reaches the least count. (2) Candidates: in each shard, those whose own bit and whose parts' bits are all set (no phrase is more frequent than its parts) are compiled
into an automaton, guarded by a space on both sides, which scans the shard's texts and counts all matches, overlapping ones too.
(3) Shards send their counts as packed blocks, a block for each range of hashes; where a range's blocks meet, they are unpacked and counts of all
shards are summed, exact for every candidate, and only then the thresholds are applied, on tables.

The sketch has 2**bits cells whatever the input, 32 MB as bits, which is what workers get. More text fills it and lets more candidates through that
don't reach the least count; they cost scanning and go when counts are summed, so the result doesn't depend on its size.

Defined results: null and empty texts have no words; a null language is `und` and counted together with a language of that name. Repeated rows
count each. Ties in scores go by count, then phrase. Fewer phrases than wanted give all there are; an empty table gives an empty one. Other
columns are ignored. Memory: a shard of shard_bytes (or one text, if longer), its candidates, and an automaton of
them. Within a megabyte of a shard, phrases are listed once by 64-bit hashes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, LOWER, written
from .textvec import hash_text, hashes, mix

#: A-Z in lower case, tabs as spaces, piece ends as line ends; no byte of a longer character is touched.
FOLD = bytes.maketrans(UPPER.encode() + b"\t" + b".,;:!?\x0b\x0c\r", LOWER.encode() + b" " + b"\n" * 9)
RUNS, ENDS = re.compile(b"  +"), re.compile(b" ?\n[ \n]*")
LONGEST = 3
RANGES = 256
COUNTED = "lang string, phrase string, words int, n long"


def normal(text: str) -> bytes:
    """The text's words with one space around each, and a line end between pieces: ` a b \\n c `."""
    return b" " + ENDS.sub(b" \n ", RUNS.sub(b" ", text.encode().translate(FOLD))).strip(b" \n") + b" "


def words(body: bytes, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, first byte of each word, byte after it, words that the part before had too) by parts of about limit bytes, so that every phrase lies whole in a part."""
    at = stop = carried = 0
    while stop < len(body):
        stop = body.find(b" ", stop + limit)
        stop = len(body) if stop < 0 else stop + 1
        buf = np.frombuffer(body, np.uint8, stop - at, at)
        out = (buf == 32) | (buf == 10)
        first, last = np.flatnonzero(out[:-1] & ~out[1:]) + 1, np.flatnonzero(~out[:-1] & out[1:]) + 1
        if len(first):
            yield buf, first, last, carried
            carried = min(LONGEST - 1, len(first))
            at += int(first[-carried]) - 1


def phrases(body: bytes, salt: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, words, first byte, byte after, hash, whether it is new) by part and length: an entry for every run of that many words of the part. New are
    the runs within a piece that no part before had."""
    for buf, first, last, carried in words(body, limit):
        for k in range(1, LONGEST + 1):
            a, b = first[: max(len(first) - k + 1, 0)], last[k - 1 :]
            new = np.arange(len(a)) + k > carried
            for i in range(k - 1):  # in one piece: a single space between the words
                new &= first[i + 1 : i + 1 + len(a)] == last[i : i + len(a)] + 1
            yield buf, k, a, b, mix(hashes(buf, a, b) + np.uint64(salt)), new


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, bytes]]:
    """(language, normal texts one after the other) of about shard_bytes; batches(lang, text)."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            if (body := normal(text.as_py())) != b"  ":
                held.setdefault(lang.as_py(), []).append(body)
                size += len(body)
            if size >= shard_bytes:
                yield from ((x, b"\n".join(t)) for x, t in held.items())
                held, size = {}, 0
    yield from ((x, b"\n".join(t)) for x, t in held.items())


def packed(raw: bytes) -> bytes:
    """Its length, then the compressed bytes."""
    return len(raw).to_bytes(8) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(block: bytes) -> bytes:
    return pa.decompress(block[8:], int.from_bytes(block[:8]), codec="zstd", asbytes=True)


def by_byte(steps: np.ndarray) -> bytes:
    """Numbers of 32 bits as all their first bytes, then all second ones: steps are small, so that most of it is zeros."""
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def sketch(texts: DataFrame, least: int, bits: int, shard_bytes: int) -> list[bytes]:
    """For each range of cells, a bit a cell: whether its sum over all texts reaches least."""
    per_range = (1 << bits) // RANGES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, body in shards(batches, shard_bytes):
            cells = np.concatenate([h[new] >> np.uint64(64 - bits) for *_, h, new in phrases(body, hash_text(lang))])
            cell, n = np.unique(cells.astype(np.uint32), return_counts=True)
            cut = np.searchsorted(cell, np.arange(RANGES + 1) * per_range)
            n = np.minimum(n, least).astype(np.uint8 if least < 256 else np.uint32)
            kinds, places, sums = [], [], []
            for k in range(RANGES):
                at = slice(cut[k], cut[k + 1])
                if at.start < at.stop:
                    kinds.append(k), places.append(packed(by_byte(np.diff(cell[at], prepend=np.uint32(k * per_range))))), sums.append(packed(n[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.binary()), pa.array(sums, pa.binary())], ["range", "steps", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, steps, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums = total.setdefault(k, np.zeros(per_range, np.uint8 if least < 128 else np.uint32))
                cell = np.cumsum(from_bytes(unpacked(steps)))
                n = np.frombuffer(unpacked(n), np.uint8 if least < 256 else np.uint32)
                sums[cell] = np.minimum(sums[cell] + n.astype(sums.dtype), least)
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["range", "bits"])

    sent = texts.mapInArrow(emit, "range int, steps binary, n binary").repartition(F.col("range"))
    found = {r["range"]: bytes(r["bits"]) for r in sent.mapInArrow(merge, "range int, bits binary").collect()}
    return [found.get(k, bytes(per_range // 8)) for k in range(RANGES)]


def matches(names: Iterable[str], body: str) -> Counter[str]:
    """How often each name, between two spaces, stands in the text, overlapping ones too."""
    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(f" {name} ", name)
    automaton.make_automaton()
    return Counter(map(itemgetter(1), automaton.iter(body)))


def blocks(lang: str, found: dict[str, int], range_of: dict[str, int]) -> pa.RecordBatch:
    """(range, lang, phrases, n): counts of a shard by the range of their hash, in the order of phrases, which then share beginnings."""
    by: dict[int, list[str]] = {}
    for name in found:
        by.setdefault(range_of[name], []).append(name)
    names, sums = [], []
    for some in by.values():
        some.sort()
        names.append(packed("\n".join(some).encode()))
        sums.append(packed(by_byte(np.fromiter(map(found.__getitem__, some), np.uint32, len(some)))))
    lists = [pa.array(list(by), pa.int32()), pa.array([lang] * len(by), pa.string()), pa.array(names, pa.binary()), pa.array(sums, pa.binary())]
    return pa.RecordBatch.from_arrays(lists, ["range", "lang", "phrases", "n"])


def opened(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows (lang, phrase, n) of blocks, of so many blocks at a time as have that many rows."""
    langs: list[str] = []
    names: list[str] = []
    sums: list[np.ndarray] = []
    full = lambda: pa.RecordBatch.from_arrays([pa.array(langs), pa.array(names), pa.array(np.concatenate(sums).astype(np.int64))], ["lang", "phrase", "n"])
    for b in batches:
        for lang, some, n in zip(*b.columns[1:], strict=True):
            sums.append(from_bytes(unpacked(n.as_py())))
            names += unpacked(some.as_py()).decode().split("\n")
            langs += [lang.as_py()] * len(sums[-1])
            if len(names) >= rows:
                yield full()
                langs, names, sums = [], [], []
    if names:
        yield full()


def count(texts: DataFrame, least: int, bits: int = 28, shard_bytes: int = 8 << 20) -> DataFrame:
    """texts(lang, text) without nulls -> (lang, phrase, words, n): exact counts of all words and phrases that may reach least, and of some others;
    for each language a row of no words with the number of all its words."""
    shared = texts.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(sketch(texts, least, bits, shard_bytes)), np.uint8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for lang, body in shards(batches, shard_bytes):
            names: dict[str, int] = {"": 0}  # and the range of each
            total = 0
            for buf, k, a, b, h, new in phrases(body, hash_text(lang)):
                total += int(new.sum()) if k == 1 else 0
                cell = h >> np.uint64(64 - bits)
                on = (marks[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
                bound = on if k == 1 else on & bound[: len(on)] & bound[1 : len(on) + 1]  # and both parts that are a word shorter
                at = np.flatnonzero(bound & new)
                at = at[np.unique(h[at], return_index=True)[1]]
                raw = buf.tobytes()
                names.update((raw[i:j].decode(), r) for i, j, r in zip(a[at].tolist(), b[at].tolist(), (cell[at] * np.uint64(RANGES) >> np.uint64(bits)).tolist(), strict=True))
            found = matches(filter(None, names), body.decode()) if len(names) > 1 else {}
            found[""] = total
            yield blocks(lang, found, names)

    sent = texts.mapInArrow(scan, "range int, lang string, phrases binary, n binary").repartition(F.col("range"))
    n = sent.mapInArrow(opened, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words_of = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    return n.select("lang", "phrase", words_of.alias("words"), "n")


def scores(counted: DataFrame, least: int, inside_pct: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases that stay."""
    ok = counted.where((F.col("words") > 0) & (F.col("n") >= least)).select("lang", "phrase", "words", "n")
    many = ok.where("words > 1").withColumnRenamed("n", "a")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    each = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    for side, f in (("left", "l"), ("right", "r")):
        each = each.join(ok.select("lang", F.col("phrase").alias(side), F.col("n").alias(f)), ["lang", side])
    each = each.withColumn("score", F.expr("cast(1000000 as decimal(8,0)) * (cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    longer = many.where("words = 3")
    inner = longer.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_pct))
    n = counted.where("words = 0").select("lang", "n")
    return stay.join(n, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top(scored: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """The first most phrases of each language: of each of its parts by hash first, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("part")


def mine(docs: DataFrame, least: int = 10, inside_pct: int = 50, most: int = 2000, bits: int = 28, shard_bytes: int = 8 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's collocations. a, l and r are the counts of the phrase and of the two sides of its weakest cut."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = written(count(texts, least, bits, shard_bytes), "phrases")
    return top(scores(counted, least, inside_pct), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
