"""Bigram language model in a log-frequency Bloom filter (operator 7).

Counting. Mappers number words by a 64-bit hash and work in blocks of up to block_tokens tokens. A block sends, to the shard
of each token and of each word pair, its count there, packed in binary blobs; pairs of documents that aren't for learning go
along with count 0, as questions. Shards add up exact counts over all blocks.

Model. Each shard puts its n-grams in its own slice of the filter, as (n-gram, level) for all levels up to
1 + floor(log2 count): all tokens, and word pairs seen pair_min times or more. A slice takes bits_per_entry bits an
entry, and nothing is left out: the filter grows with the corpus. It is never gathered: slices stay with their shards, which
answer each block with the counts and levels of what it sent. A count is
read by probing level after level until one is missing; it then stands for the mean count of its level. The word's
probability given the one before is lambda(level of the one before) * pair / before + (1 - lambda) * unigram; an
unseen word has the Good-Turing mass of the words seen once. The lambdas come from expectation maximisation over
about 1 in dev_part learning documents, whose pairs are read from a second slice that has the other documents' pairs only; scores
are read from the one that has all.

Scoring. A second run over the same blocks joins the answers. A token's probability depends on three levels only, so a
document becomes a histogram of them, which is scored once the lambdas are known.

Learning rows: crc32 of the id modulo 7 is not 2. Defined results: null and empty texts are the end token only; with no
learning rows no word is known (N = V = 0) and both scores are 0. Repeated rows are scored, and counted, each for itself. Rows are numbered
and written first, so that both runs see the same; extra columns are ignored. Memory: a block, or a shard's blobs and slice."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, written
from .textvec import hash_text, mix, tokens

END = hash_text("\n\n")
BEGIN = hash_text("\n")
TOKENS, PAIRS, FIRST, OWN, STATS = range(5)
LEVELS = 48
UNBOUNDED = 1 << 62
BINS = np.r_[-np.inf, np.arange(-24, 24.25, 0.25)]
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed blob."""
    head = json.dumps([(str(a.dtype), len(a)) for a in arrays]).encode()
    raw = len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for kind, size in json.loads(raw[4:at]):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out


def pack_sorted(h: np.ndarray) -> np.ndarray:
    """Sorted 64-bit values as differences in byte planes, which compress."""
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def unpack_sorted(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel())


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _A + word)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def token_stream(column: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, token, token before) by chunk, with the end token of each row; row numbers come from rows."""
    last = BEGIN
    for row, h, whole in tokens(column):
        # Ends go in after the last token of each row that ends here.
        at = np.searchsorted(row, whole, "right")
        h = np.insert(h, at, np.uint64(END))
        row = np.insert(row, at, whole)
        before = np.r_[np.uint64(last), h[:-1]] if len(h) else h
        new = np.r_[False, row[1:] != row[:-1]] if len(h) else np.zeros(0, bool)
        before[new] = np.uint64(BEGIN)
        if len(h):
            last = BEGIN if h[-1] == np.uint64(END) and len(whole) and whole[-1] == row[-1] else int(h[-1])
        yield rows[row], h, before


def _asked(key: int, h: np.ndarray, before: np.ndarray, learn: np.ndarray, dev: np.ndarray, shards: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The blobs of a block for the shards. learn and dev: by token, whether it counts, and is of a dev document."""
    own, of = np.unique(h, return_inverse=True)
    n = np.bincount(of, learn, len(own)).astype(np.uint32)
    cuts = np.searchsorted(shard_of(own, shards), np.arange(shards + 1))
    for k in range(shards):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            yield k, TOKENS, key, pack(pack_sorted(own[a:b]), n[a:b])
    p, of = np.unique(pair_hash(before, h), return_inverse=True)
    n, n_dev = (np.bincount(of, x, len(p)).astype(np.uint32) for x in (learn, learn & dev))
    cuts = np.searchsorted(shard_of(p, shards), np.arange(shards + 1))
    for k in range(shards):
        a, b = cuts[k], cuts[k + 1]
        if a < b:  # 40 bits within a shard do for a filter
            yield k, PAIRS, key, pack(pack_sorted(p[a:b] >> np.uint64(24))[: 6 * (b - a)], n[a:b], n_dev[a:b])
    if before[0] != np.uint64(BEGIN):  # a document goes on here: its last token is in the block before
        yield int(shard_of(before[:1], shards)[0]), FIRST, key, pack(before[:1])


def _kept(key: int, docs: np.ndarray, ids: list, held: np.ndarray, dev: np.ndarray, row: np.ndarray, h: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """The blob of a block for itself. row: numbers in docs."""
    own, of = np.unique(h, return_inverse=True)
    planes = of.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()
    yield key, OWN, 0, pack(pack_sorted(own), planes, docs, np.array([x is not None for x in ids]), np.array([x or 0 for x in ids], np.int64), held, dev, np.bincount(row, minlength=len(docs)), before[:1])


def mapper(shards: int, block_tokens: int, ask: bool):
    """Batches (row key, doc_id, learning, dev, text) -> (key, kind, block, blob): what blocks ask the shards, or what they keep for
    themselves, with the block as key. Both runs cut the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        held: dict[str, list] = {k: [] for k in ("docs", "ids", "learn", "dev", "row", "h", "before")}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held["docs"]:
                return
            docs = np.array(held["docs"], np.int64)
            learn, dev = np.array(held["learn"], bool), np.array(held["dev"], bool)
            row, h, before = (np.concatenate(held[k]) for k in ("row", "h", "before"))
            base = docs[0]
            place = np.cumsum(np.r_[False, row[1:] != row[:-1]])  # rows come one after the other, though not by number
            block = int(base) * 4096 + int(sum(held["cuts"])) % 4096
            out = _asked(block, h, before, learn[place], dev[place], shards) if ask else _kept(block, docs, held["ids"], ~learn, learn & dev, place, h, before)
            for x in out:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], ["key", "kind", "block", "blob"])

        held["cuts"] = [0]
        for b in batches:
            key = b.column(0).to_numpy()
            ids, learn, dev = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for row, h, before in token_stream(b.column(4), np.arange(len(key))):
                i = 0
                while i < len(row):
                    room = max(1, block_tokens - size)
                    j = min(i + room, len(row))
                    j = min(j, int(np.searchsorted(row, row[i] + 60_000 - len(held["docs"]), "left")) if len(held["docs"]) < 60_000 else i)
                    if j > i:
                        used = np.unique(row[i:j])
                        for r in used.tolist():
                            if not held["docs"] or held["docs"][-1] != key[r]:
                                held["docs"].append(int(key[r])), held["ids"].append(ids[r]), held["learn"].append(learn[r]), held["dev"].append(dev[r])
                        held["row"].append(key[row[i:j]]), held["h"].append(h[i:j]), held["before"].append(before[i:j])
                        size += j - i
                    if size >= block_tokens or len(held["docs"]) >= 60_000 or j == i:
                        yield from flush()
                        cut_no = held["cuts"][0] + 1
                        held = {k: [] for k in held} | {"cuts": [cut_no]}
                        size = 0
                    i = j
        yield from flush()

    return run


def count_levels(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c), 0 for 0


def slots(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int, probes: int) -> Iterator[np.ndarray]:
    a = mix(h + np.uint64(1) + np.asarray(level).astype(np.uint64) * _B)
    step = (a >> np.uint64(17)) | np.uint64(1)
    for _ in range(probes):
        yield (a % np.asarray(bits).astype(np.uint64)).astype(np.int64)
        a = a + step


def build_slice(grams: list[tuple[np.ndarray, np.ndarray]], bits_per_entry: float, most_bits: int, probes: int) -> tuple[np.ndarray, list[int]]:
    """(bytes of the slice, least count kept by kind) for [(hashes, counts) of tokens, of pairs]."""
    least = [1, 1]
    levels = [count_levels(c) for _, c in grams]
    while sum(int(v[c >= m].sum()) for v, (_, c), m in zip(levels, grams, least, strict=True)) * bits_per_entry > most_bits:
        k = 1 if (grams[1][1] >= least[1]).any() else 0  # pairs go first
        least[k] = least[k] * 2
    entries = sum(int(v[c >= m].sum()) for v, (_, c), m in zip(levels, grams, least, strict=True))
    size = max(64, -(-int(entries * bits_per_entry) // 64) * 64)
    on = np.zeros(size, bool)
    for v, (h, c), m in zip(levels, grams, least, strict=True):
        keep = c >= m
        h, v = h[keep], v[keep]
        for i in range(0, len(h), 1 << 18):
            own, top = h[i : i + (1 << 18)], v[i : i + (1 << 18)]
            for level in range(1, int(top.max(initial=0)) + 1):
                for at in slots(own[top >= level], level, size, probes):
                    on[at] = True
    return np.packbits(on), least


def add_pairs(hashes: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(distinct hashes, their places by blob, their summed counts of each kind) of blobs' sorted hashes and counts."""
    p = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    at, total = [], [np.zeros(len(p), np.int64) for _ in range(2)]
    for h, cs in zip(hashes, counts, strict=True):
        i = np.searchsorted(p, h)
        at.append(i.astype(np.int32))
        for t, c in zip(total, cs, strict=True):
            np.add.at(t, i, c.astype(np.int64))
    return p, at, total


def reducer(pair_min: int, bits_per_entry: float, probes: int):
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("blob", pa.binary())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        kinds, blocks, blobs = t.column("kind").to_numpy(), t.column("block").to_numpy(), t.column("blob")
        of = lambda kind: [unpack(blobs[int(j)].as_py()) for j in np.flatnonzero(kinds == kind)]
        own, h = of(TOKENS), []
        for x in own:
            h.append(unpack_sorted(x[0]))
        words, inverse = np.unique(np.concatenate(h), return_inverse=True) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts = np.bincount(inverse, np.concatenate([x[1] for x in own]) if own else None, len(words)).astype(np.int64)
        asked = of(PAIRS)
        p, places, (all_n, dev_n) = add_pairs([unpack_sorted(np.r_[x[0], np.zeros(2 * len(x[1]), np.uint8)]) << np.uint64(24) for x in asked], [x[1:] for x in asked])
        del asked
        seen, out = counts > 0, []

        def slice_of(n: np.ndarray) -> tuple[Model, dict]:
            """The slice of all tokens and of the pairs by these counts, as a model, and its statistics."""
            grams = [(words[seen], counts[seen]), (p[n >= pair_min], n[n >= pair_min])]
            bits, least = build_slice(grams, bits_per_entry, UNBOUNDED, probes)
            stats: dict = {"least": least, "once": int((counts == 1).sum())}
            for name, (_, c) in zip(("token", "pair"), grams, strict=True):
                v = count_levels(c)
                stats[name] = [np.bincount(v, minlength=LEVELS).tolist(), np.bincount(v, c, LEVELS).tolist(), 0, 0]
            return Model([bits.tobytes()], [stats], probes), stats

        # Dev documents' pairs by the slice without them; it is gone before the whole one is made.
        model, stats = slice_of(all_n - dev_n)
        dev_level, of_dev = np.zeros(len(p), np.uint8), dev_n > 0
        dev_level[of_dev] = model.levels(p[of_dev])
        rest = stats["pair"]
        del model
        model, stats = slice_of(all_n)
        level, pair_level = model.levels(words).astype(np.uint8), model.levels(p).astype(np.uint8)
        i = 0
        for b, x in zip(blocks[kinds == TOKENS].tolist(), h, strict=True):
            mine = inverse[i : i + len(x)]
            i += len(x)
            out.append((b, TOKENS, k, pack(counts[mine], level[mine])))
        for b, at in zip(blocks[kinds == PAIRS].tolist(), places, strict=True):
            out.append((b, PAIRS, k, pack(pair_level[at], dev_level[at])))
        for b, (x,) in zip(blocks[kinds == FIRST].tolist(), of(FIRST), strict=True):
            out.append((b, FIRST, k, pack(model.levels(x).astype(np.uint8))))
        out.append((k, STATS, k, json.dumps(stats | {"rest": rest}).encode()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


LEVELLED = "row long, doc_id long, held_out boolean, n_tokens long, x double, n long, codes array<int>, times array<int>"


def histogram(place: np.ndarray, code: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """By place from 0 to n - 1: the codes there and how often each."""
    both, times = np.unique(place * CODES + code, return_counts=True)
    offsets = pa.array(np.searchsorted(both, np.arange(n + 1) * CODES), pa.int32())
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (both % CODES, times))


def assemble(key: tuple, t: pa.Table) -> pa.Table:
    """What a block kept and the shards' answers -> rows of its documents, and one without number for its dev documents."""
    got: dict[int, list] = {TOKENS: [], PAIRS: [], FIRST: [], OWN: []}
    for kind, part, blob in sorted(zip(t.column("kind").to_pylist(), t.column("part").to_pylist(), t.column("blob"), strict=True), key=lambda x: x[:2]):
        got[kind].append(unpack(blob.as_py()))
    own, planes, docs, has_id, ids, held, dev, n, start = got[OWN][0]
    own, of = unpack_sorted(own), np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    counts, level = (np.concatenate([x[i] for x in got[TOKENS]]) for i in range(2))
    pair_level, dev_level = (np.concatenate([x[i] for x in got[PAIRS]]) for i in range(2))
    place, h = np.repeat(np.arange(len(docs)), n), own[of]
    new = np.r_[start[0] == np.uint64(BEGIN), place[1:] != place[:-1]]
    before = np.r_[start, h[:-1]]
    before[new] = np.uint64(BEGIN)
    _, at = np.unique(pair_hash(before, h), return_inverse=True)
    mine = level[of].astype(np.int64)
    ahead = np.r_[got[FIRST][0][0].astype(np.int64) if got[FIRST] else np.zeros(1, np.int64), mine[:-1]]
    ahead[new] = LEVELS
    code = lambda levels: code_of(mine, ahead, np.where((mine > 0) & (ahead > 0), levels[at], 0))
    logs, c = np.log10(counts + 1.0)[of], counts[of]
    codes, times = histogram(place, code(pair_level), len(docs))
    learned = dev[place]
    dev_codes, dev_times = histogram(np.zeros(int(learned.sum()), np.int64), code(dev_level)[learned], 1)
    cols = [
        pa.array(np.r_[docs, 0], mask=np.r_[np.zeros(len(docs), bool), True]), pa.array(np.r_[ids, 0], mask=np.r_[~has_id, True]), pa.array([*held.tolist(), None], pa.bool_()), pa.array(np.r_[n, 0], pa.int64()),
        pa.array(np.r_[np.bincount(place, logs, len(docs)), 0.0]), pa.array(np.r_[np.bincount(place, c > 0, len(docs)), 0].astype(np.int64)), pa.concat_arrays([codes, dev_codes]), pa.concat_arrays([times, dev_times]),
    ]
    return pa.table(cols, names=["row", "doc_id", "held_out", "n_tokens", "x", "n", "codes", "times"])


CODES = LEVELS * (LEVELS + 1) * LEVELS


def code_of(own: np.ndarray, ahead: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """One number for the levels of a token, of the one before, and of their pair."""
    return (own * (LEVELS + 1) + ahead) * LEVELS + pair


class Model:
    """The filter and what goes with it. slices: bytes by shard."""

    def __init__(self, slices: list[bytes], stats: list[dict], probes: int):
        self.shards, self.probes = len(slices), probes
        self.bits = np.array([8 * len(s) for s in slices], np.int64)
        self.offset = np.r_[0, np.cumsum(self.bits)][:-1]
        self.data = np.frombuffer(b"".join(slices), np.uint8)
        add = lambda name, i: np.sum([s[name][i] for s in stats], axis=0)
        self.types = int(sum(add("token", 0))) + int(add("token", 2))
        self.n = int(sum(add("token", 1))) + int(add("token", 3))
        self.token_mean = np.r_[0.0, (add("token", 1) / np.maximum(add("token", 0), 1))[1:]]
        self.pair_mean = np.r_[0.0, (add("pair", 1) / np.maximum(add("pair", 0), 1))[1:]]
        unseen = sum(s["once"] for s in stats) / max(self.n, 1)
        self.unseen = min(max(unseen, 1.0 / (self.n + self.types + 1)), 0.5)
        # Tokens left out of the filter can't be told from unseen ones: they share their mass evenly.
        self.missing = (self.unseen + (1 - self.unseen) * float(add("token", 3)) / max(self.n, 1)) / (1 + int(add("token", 2)))

    def levels(self, h: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """The level of each n-gram: probes go on level after level while all its bits are set."""
        if len(h) > step:
            return np.concatenate([self.levels(h[i : i + step], step) for i in range(0, len(h), step)])
        s = shard_of(h, self.shards)
        bits, offset = self.bits[s], self.offset[s]
        out, live = np.zeros(len(h), np.int64), np.arange(len(h))
        for level in range(1, LEVELS):
            if not len(live):
                break
            here = np.arange(len(live))
            for at in slots(h[live], level, bits[live], self.probes):
                at = at[here] + offset[live[here]]
                here = here[(self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            live = live[here]
            out[live] = level
        return out

    def chances(self, code: np.ndarray, pair_mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level of the word before, probability by word pair, by the word alone) for each code."""
        own, ahead, pair = code // ((LEVELS + 1) * LEVELS), code // LEVELS % (LEVELS + 1), code % LEVELS
        alone = np.where(own > 0, (1 - self.unseen) * self.token_mean[own] / max(self.n, 1), self.missing)
        times = np.where(ahead == LEVELS, self.token_mean[count_levels(np.array([self.ends]))[0]] if self.ends else 1.0, self.token_mean[np.minimum(ahead, LEVELS - 1)])
        return ahead, np.minimum((self.pair_mean if pair_mean is None else pair_mean)[pair] / np.maximum(times, 1), 1.0), alone

    ends = 0


def learn_lambdas(hist: np.ndarray, rounds: int = 50) -> np.ndarray:
    """By level of the word before: the weight of the pair's probability, given a histogram of log2(pair / alone)."""
    ratio = np.r_[0.0, 2.0 ** (BINS[1:] + 0.125)]
    lam = np.full(len(hist), 0.3)
    for _ in range(rounds):
        up = lam[:, None] * ratio
        share = up / (up + 1 - lam[:, None])
        lam = ((hist * share).sum(axis=1) + 0.1) / (hist.sum(axis=1) + 1.0)
    return np.clip(lam, 1e-4, 0.99)


def scored(docs: DataFrame, *, folds: int = 7, shards: int | None = None, shard_bytes: int = 16 << 20, block_tokens: int = 300_000, pair_min: int = 1, bits_per_entry: float = 9.0, probes: int = 5, dev_part: int = 40) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    held = fold(F.col("doc_id"), folds) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (~held).alias("learn"), (F.pmod(F.xxhash64("doc_id", F.lit("dev")), F.lit(dev_part)) == 0).alias("dev"), "text"
    )
    rows = written(rows, "rows")  # read twice, each row with its number
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(12, -(-size // shard_bytes))
    sent = rows.mapInArrow(mapper(shards, block_tokens, True), "key long, kind int, block long, blob binary")
    got = written(sent.groupBy("key").applyInArrow(reducer(pair_min, bits_per_entry, probes), "key long, kind int, part long, blob binary"), "counts")
    none = [[0] * LEVELS, [0] * LEVELS, 0, 0]
    stats = [json.loads(bytes(r["blob"])) for r in got.where(F.col("kind") == STATS).select("blob").collect()] or [{"once": 0, "token": none, "pair": none, "rest": none}]
    model = Model([bytes(8)], stats, 0)
    model.ends = rows.where("learn").count()
    kept = rows.mapInArrow(mapper(shards, block_tokens, False), "key long, kind int, part long, blob binary")
    levels = written(got.where(F.col("kind") != STATS).unionByName(kept).groupBy("key").applyInArrow(assemble, LEVELLED), "levels")

    each = levels.where("row is null").select(F.explode(F.arrays_zip("codes", "times")).alias("c"))
    dev = np.array([tuple(r) for r in each.groupBy("c.codes").agg(F.sum("c.times")).collect()], np.int64).reshape(-1, 2)
    total, mass = (np.sum([s["rest"][i] for s in stats], axis=0) for i in range(2))
    hist = np.zeros((LEVELS + 1, len(BINS)))
    ahead, pair, alone = model.chances(dev[:, 0], np.r_[0.0, (mass / np.maximum(total, 1))[1:]])
    with np.errstate(divide="ignore"):
        k = np.where(pair > 0, np.clip(np.floor((np.log2(pair / alone) + 24) * 4), 0, len(BINS) - 2) + 1, 0).astype(np.int64)
    np.add.at(hist, (ahead, k), dev[:, 1])
    lambdas = learn_lambdas(hist)
    ahead, pair, alone = model.chances(np.arange(CODES))
    lam = lambdas[ahead]
    with np.errstate(divide="ignore"):  # levels that no token has
        logs = sc.broadcast(np.log10(lam * pair + (1 - lam) * alone) if model.n else np.zeros(CODES))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, times = b.column(5), b.column(6)
            row = np.repeat(np.arange(len(b)), codes.value_lengths().to_numpy())
            got = np.bincount(row, logs.value[codes.flatten().to_numpy()] * times.flatten().to_numpy(), len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(7), pa.array(got.astype(np.float64))], ["row", "doc_id", "held_out", "n_tokens", "x", "n", "score"])

    parts = levels.where("row is not null").select("row", "doc_id", "held_out", "n_tokens", "x", "codes", "times", "n").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, x double, n long, score double")
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n").alias("n_known"), F.sum("x").alias("x"), F.sum("score").alias("score"))
    below = float(np.log10(model.n + model.types + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), (F.col("x") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")
