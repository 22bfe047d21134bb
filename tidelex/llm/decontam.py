"""Benchmark decontamination by pigeonhole edit matching (operator 6).

Items and texts are lower-cased, with single spaces for ASCII whitespace. An item of m characters may be found with up to
k = floor(m * error_rate) edits (insertions, deletions, substitutions). It is split into k + 1 pieces, of which any such
occurrence holds one unchanged; an automaton finds all pieces of all items in one pass over a text, and each
place so found is verified by Myers' bit-parallel distance, first of the short runs of pieces around it, each with an
error budget of its own, and last of the whole item, over the window that it could take.

The benchmark is taken in blocks of at most block_chars characters, one pass over the documents each, so what
is sent to the workers is bounded whatever the benchmark's size.

Defined results: null and empty texts have no hits; null and empty items are skipped; an item under min_chars must
stand unchanged between spaces; repeated items are reported each, repeated rows each for itself, and of several places
in a text the one with the fewest edits, then the first. Memory: one text, the automaton of a block, and the last verdicts on runs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def simplified(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split()).decode("utf-8")


def masks(pattern: str) -> dict[str, int]:
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    return dict(at)


def best_end(at: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(fewest edits, where such an occurrence first ends) of the pattern anywhere in text, if that is at most most."""
    full = (1 << m) - 1
    plus, minus, errors, best = full, 0, m, None
    top = 1 << (m - 1)
    for i, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        diagonal = ((((eq & plus) + plus) ^ plus) | eq) & full
        grow = minus | (full & ~(diagonal | plus))
        shrink = plus & diagonal
        if grow & top:
            errors += 1
        elif shrink & top:
            errors -= 1
        grow, shrink = (grow << 1) & full, (shrink << 1) & full
        plus = shrink | (full & ~(vertical | grow))
        minus = grow & vertical
        if errors <= most and (best is None or errors < best[0]):
            best = (errors, i + 1)
            if errors == 0:
                break
    return best


class Node:
    """A run of an item's pieces, which may hold one edit less than it has pieces, and the run it is half of."""

    def __init__(self, pattern: str, cuts: list[int], low: int, high: int, parent: Node | None):
        self.start, self.stop, self.most, self.parent = cuts[low], cuts[high], high - low - 1, parent
        self.masks = masks(pattern[self.start : self.stop]) if self.most else {}

    def leaves(self, pattern: str, cuts: list[int], low: int, high: int) -> Iterator[Node]:
        if high - low == 1:
            yield self
            return
        mid = (low + high) // 2
        for a, b in ((low, mid), (mid, high)):
            yield from Node(pattern, cuts, a, b, self).leaves(pattern, cuts, a, b)


class Matcher:
    """Finds (item id, edits, start of the window in the simplified text) of a block's items.

    Where a piece stands, the runs of pieces that it is part of are tried from the shortest on: of the halves of a run
    that occurs within its edits one does so within its own, so a place that holds the item passes all of them, and most others
    fail at the first, of two pieces and one edit."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int, most_seen: int = 200_000):
        self.items, self.seen, self.most_seen = [], {}, most_seen
        pieces: dict[str, list[tuple[int, Node]]] = defaultdict(list)
        for item_id, text in items:
            n, m = len(self.items), len(text)
            k = int(m * error_rate) if m >= min_chars else 0
            pattern = text if m >= min_chars else f" {text} "
            cuts = [len(pattern) * j // (k + 1) for j in range(k + 2)]
            self.items.append((item_id, pattern, k, masks(pattern)))
            for leaf in Node(pattern, cuts, 0, k + 1, None).leaves(pattern, cuts, 0, k + 1):
                pieces[pattern[leaf.start : leaf.stop]].append((n, leaf))
        self.find = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.find.add_word(p, (len(p), where))
        self.find.make_automaton()

    def holds(self, line: str, leaf: Node, at: int) -> bool:
        """Whether all runs below the whole item occur around its piece at that place."""
        node = leaf.parent
        while node is not None and node.parent is not None:
            low = at - (leaf.start - node.start) - node.most
            window = line[max(0, low) : at + (node.stop - leaf.start) + node.most]
            ok = self.seen.get((node, window))
            if ok is None:
                if len(self.seen) >= self.most_seen:
                    self.seen.clear()
                ok = self.seen[node, window] = best_end(node.masks, node.stop - node.start, window, node.most) is not None
            if not ok:
                return False
            node = node.parent
        return True

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        line = f" {simplified(text)} "
        places: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.find.iter(line):
            for n, leaf in where:
                if self.holds(line, leaf, end + 1 - size):
                    places[n].append(end + 1 - size - leaf.start)
        out = []
        for n, starts in places.items():
            item_id, pattern, k, at = self.items[n]
            m, best = len(pattern), None
            exact = line.find(pattern)
            if exact >= 0:
                best = (0, exact)
            elif k:
                starts.sort()
                i = 0
                while i < len(starts):  # places whose windows overlap are verified at once
                    j = i
                    while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * k and starts[j + 1] - starts[i] <= m:
                        j += 1
                    low = max(0, starts[i] - k)
                    got = best_end(at, m, line[low : starts[j] + m + k], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], low)
                    i = j + 1
            if best:
                out.append((item_id, *best))
        return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_chars characters (or one item), a few rows at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        if t := simplified(r["t"]):
            if block and size + len(t) > block_chars:
                yield block
                block, size = [], 0
            block.append((r["i"], t))
            size += len(t)
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.1, min_chars: int = 40, block_chars: int = 1 << 20) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, errors, at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, errors long, at long"
    out = None
    for block in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, error_rate, min_chars)
            for b in batches:
                got = [(d, *h) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for h in m.hits(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(4)], ["doc_id", "item_id", "errors", "at"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.1, min_chars: int = 40, block_chars: int = 1 << 20) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    own = docs.columns
    out = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at, schema = own.index("text"), T.StructType(list(out.schema.fields))
    for block in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, error_rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not m.hits(t.as_py()) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
