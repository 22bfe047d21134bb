"""SimHash near-duplicates by a binary trie self-join (operator 4).

Fingerprints: ASCII-lower-cased words, 4-word shingles with repeats, joined by a space; a bit is set if over half of the
shingles' XXH64 hashes (seed 42) have it. Fewer words: one shingle of all words; none: fingerprint zero.

Links: distinct fingerprints only, which are the nodes of the graph, so copies cost nothing and ids may be null or repeated. Two fingerprints within
the error budget agree on some blocks of the 64 bits (budget + r blocks, r agree), so each goes to the buckets of its
block combinations; r grows with the number of fingerprints so that buckets stay small. In a bucket the sorted
fingerprints are a binary trie: pairs of nodes go down together, one bit a level, their differing bits add up and
pairs over the budget, or of leaves that are connected already, are pruned. A bucket gives a spanning forest of its
links, never all pairs. A bucket above max_bucket is split into parts, and all pairs of parts are joined as tasks
of their own. Components come from the forests' edges by star contraction; a component's id is its least doc_id, found afterwards.

Defined results: null texts count as empty; all texts without words link to each other; a null doc_id counts as
larger than any other, and the id of a component without any doc_id is null; repeated rows are returned as often as they come. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_hash
from .components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in arrays of bounded length."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    line = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, ends[:-1] + 1][: len(words) - size + 1].tolist()
    last = ends[size - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    for i in range(0, len(first), 1 << 16):
        yield np.array([of(line[a:b], 42) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)], strict=True)], np.uint64)


def fingerprint(text: bytes, size: int = 4) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n).view(">u8")[0]) if n else 0


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """docs(id, key, text) -> (id, key, fp): fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "key", "fp"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key binary, fp long")


def blocks(n: int, budget: int, per_bucket: int) -> tuple[int, list[tuple[int, int]]]:
    """(how many of the blocks must agree, the blocks as (first bit, bits)): the fewest for which random fingerprints fill
    buckets with about per_bucket. A block's key takes only as many of its bits as that needs."""
    need = max(0, int(np.ceil(np.log2(max(n, 1) / per_bucket))))
    for agree in range(1, 7):
        m = budget + agree
        if need <= agree * (64 // m):
            break
    cuts = [64 * i // m for i in range(m + 1)]
    take = -(-need // agree)
    return agree, [(a, min(take, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_keys(fp: Column, agree: int, parts: list[tuple[int, int]]) -> Column:
    """An array with the key of each combination of blocks: the combination's number and the fingerprint's bits there."""
    keys = []
    for k, combo in enumerate(combinations(parts, agree)):
        mask = sum(((1 << n) - 1) << a for a, n in combo)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).alias("combo"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Components of positions 0..n-1, with the least position as root, and the edges that joined them."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[np.ndarray] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r = self.roots()
            ra, rb = r[a], r[b]
            keep = ra != rb
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            if not len(a):
                return
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            hi, at = np.unique(hi, return_index=True)  # one new parent for each root a round: no cycles, as parents are smaller
            self.up[hi] = lo[at]
            self.edges.append(np.c_[a[at], b[at]])


def trie_join(fps: np.ndarray, budget: int, side: np.ndarray | None = None, leaf: int = 256, width: int = 1 << 16) -> np.ndarray:
    """A spanning forest, as position pairs, of the links within budget bits among sorted distinct fingerprints. With
    side (0 or 1 for each), only links between the sides count. Budgets rise one by one, so that dense groups are connected by
    their shortest links and most of their pairs of nodes are pruned."""
    n = len(fps)
    forest = Forest(n)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    for limit in range(1, budget + 1):
        changes = _changes(forest, side)
        stack = [(64, np.array([[0, n, 0, n, 0]]))]  # bits below this node level; ranges [a, b) and [c, d); differing bits so far
        while stack:
            level, pairs = stack.pop()
            if len(pairs) > width:
                stack += [(level, pairs[i : i + width]) for i in range(0, len(pairs), width)]
                continue
            a, b, c, d, e = pairs.T
            lo, hi = np.minimum(a, c), np.maximum(b, d)
            # Connected already: both ranges, and all between them, have one root.
            done = (changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c]) & (forest.up[a] == forest.up[c]) if side is None else (changes[hi - 1] == changes[lo])
            pairs = pairs[~done]
            if not len(pairs):
                continue
            a, b, c, d, e = pairs.T
            small = (b - a) * (d - c) <= leaf if level else np.ones(len(pairs), bool)
            if small.any():
                x, y = _expand(pairs[small])
                near = popcount(fps[x] ^ fps[y]) <= limit
                near &= x < y if side is None else side[x] != side[y]
                if near.any():
                    forest.join(x[near], y[near])
                    changes = _changes(forest, side)
            pairs = pairs[~small]
            if not len(pairs):
                continue
            a, b, c, d, e = pairs.T
            bit = np.uint64(1) << np.uint64(level - 1)
            m1, m2 = _split(fps, a, b, bit, level), _split(fps, c, d, bit, level)
            same = (a == c) & (b == d)
            kids = [np.c_[a, m1, c, m2, e], np.c_[m1, b, m2, d, e], np.c_[a, m1, m2, d, e + 1]]
            cross = np.c_[m1, b, c, m2, e + 1][~same]
            kids = np.concatenate([*kids, cross])
            ok = (kids[:, 1] > kids[:, 0]) & (kids[:, 3] > kids[:, 2]) & (kids[:, 4] <= limit)
            if ok.any():
                stack.append((level - 1, kids[ok]))
    return np.concatenate(forest.edges) if forest.edges else np.zeros((0, 2), np.int64)


def _changes(forest: Forest, side: np.ndarray | None) -> np.ndarray:
    """For each position, how many positions up to it have another root than the one before."""
    forest.up = r = forest.roots()
    return np.r_[0, np.cumsum(r[1:] != r[:-1])]


def _split(fps: np.ndarray, a: np.ndarray, b: np.ndarray, bit: np.uint64, level: int) -> np.ndarray:
    """The first position in each range whose bit is set: the border between a node's two children."""
    high = ~((bit << np.uint64(1)) - np.uint64(1)) if level < 64 else np.uint64(0)
    return np.clip(np.searchsorted(fps, (fps[a] & high) | bit), a, b)


def _expand(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All position pairs of the range pairs."""
    a, b, c, d = pairs[:, :4].T
    n = (b - a) * (d - c)
    k = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[k] + at // (d - c)[k], c[k] + at % (d - c)[k]


def links(reps: DataFrame, budget: int = 4, per_bucket: int = 512, max_bucket: int = 4096) -> DataFrame:
    """reps(fp) of distinct fingerprints -> (a, b): edges between them that connect all that are within budget."""
    agree, parts = blocks(reps.count(), budget, per_bucket)
    keyed = reps.select("fp", F.explode(block_keys(F.col("fp"), agree, parts)).alias("k")).select("fp", "k.combo", "k.bits")
    big = keyed.groupBy("combo", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    keyed = keyed.join(big, ["combo", "bits"])
    pieces = F.ceil(F.col("n") / F.lit(float(max_bucket))).cast("int")
    keyed = keyed.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    # A bucket of p pieces makes p * (p + 1) / 2 tasks; each fingerprint takes part in p of them.
    spread = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "combo", "bits", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"
    )

    def run(key: tuple, t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fp)
        fp, own = fp[order], t.column("own").to_numpy()[order]
        i, j = key[2].as_py(), key[3].as_py()
        e = trie_join(fp, budget, None if i == j else (own == j).astype(np.int8))
        fp = fp.view(np.int64)
        return pa.table({"a": fp[e[:, 0]], "b": fp[e[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return spread.groupBy("combo", "bits", "i", "j").applyInArrow(run, "a long, b long")


def classes(each: DataFrame, budget: int = 4, **params) -> DataFrame:
    """each(id, key, fp) -> (fp, part, first): by distinct fingerprint its component, named by the least fingerprint, and the
    component's first (last, id, key): the least id, null ids last, then the least key."""
    reps = cut(each.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")))
    found = components(links(reps.select("fp"), budget, **params))
    top = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"), "first")
    return top.select("fp", "part").join(top.groupBy("part").agg(F.min("first").alias("first")), "part")


def near_duplicates(docs: DataFrame, *, size: int = 4, **params) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(None).cast("binary").alias("key"), F.col("text").cast("string").alias("text"))
    each = cut(fingerprints(rows, size))
    out = each.join(classes(each, **params), "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_first(docs: DataFrame, *, size: int = 4, **params) -> DataFrame:
    """One document of each component, one with the least doc_id, with its own columns; of rows that share this doc_id
    within the component, one stays. Rows are told apart by doc_id and the text's SHA-256."""
    own = docs.columns
    text = F.col("text").cast("string")
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("key"))
    each = cut(fingerprints(base, size))
    stay = classes(each, **params).select("first").distinct().select(F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"))
    out = base.drop("text").join(stay, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    one = Window.partitionBy("id", "key").orderBy(row_hash([(f"c{i}", k) for i, (_, k) in enumerate(docs.dtypes)]))
    return out.withColumn("i", F.row_number().over(one)).where("i = 1").select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
