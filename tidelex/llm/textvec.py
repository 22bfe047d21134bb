"""Vectorised tokenising, hashing and n-grams over the bytes of Arrow string columns (numpy only).

A batch is cut into chunks of bounded size; a longer text is cut at whitespace, so no token is ever split and
memory doesn't follow the longest text (except for a single token that is longer than a chunk)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _pow(n: int, which: str) -> np.ndarray:
    a = _powers.get(which)
    if a is None or len(a) < n:
        a = np.full(max(n, CHUNK + 1), _P if which == "p" else _P_INV, np.uint64)
        a[0] = 1
        _powers[which] = a = np.multiply.accumulate(a)
    return a[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))


def chunks(offsets: np.ndarray, data: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte of each piece, row of each piece, whether the piece ends its row), in row order."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > limit:
            at, end = int(offsets[i]), int(offsets[i + 1])
            while at < end:
                stop = min(at + limit, end)
                while stop < end and not (w := np.flatnonzero(_WS[data[stop : min(stop + limit, end)]])[:1]).size:
                    stop = min(stop + limit, end)
                if stop < end:
                    stop += int(w[0])
                yield data[at:stop], np.zeros(1, np.int64), np.array([i]), np.array([stop == end])
                at = stop
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], np.arange(i, j), np.ones(j - i, bool)
        i = j


def token_bounds(buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than whitespace, not going over the pieces' bounds."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _WS[buf]
    new = np.zeros(n + 1, bool)
    new[np.minimum(first, n)] = True
    begin = ~space
    end = begin.copy()
    begin[1:] &= space[:-1] | new[1:n]
    end[:-1] &= space[1:] | new[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _pow(n + 1, "p")[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _pow(n + 1, "i")[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def tokens(column: pa.Array, lower: bool = True, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each token, its hash, rows that end here) by chunk, in order."""
    offsets, data = utf8(column)
    for buf, first, rows, whole in chunks(offsets, data, limit):
        buf = _LOW[buf] if lower else buf
        starts, ends = token_bounds(buf, first)
        yield rows[np.searchsorted(first, starts, "right") - 1], hashes(buf, starts, ends), rows[whole]


_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


def word_features(column: pa.Array, prefixes: tuple[int, ...], limit: int = CHUNK) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(row of each token, hashes by feature, which tokens have that feature) by chunk: the lower-cased word without
    outer ASCII punctuation, then its first bytes for each prefix length (words of that many bytes or more)."""
    offsets, data = utf8(column)
    for buf, first, rows, _ in chunks(offsets, data, limit):
        buf = _LOW[buf]
        starts, ends = token_bounds(buf, first)
        row = rows[np.searchsorted(first, starts, "right") - 1]
        for _ in range(8):
            ends = ends - (_PUNCT[buf[ends - 1]] & (ends - starts > 1))
            starts = starts + (_PUNCT[buf[starts]] & (ends - starts > 1)) if len(starts) else starts
        n = len(buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _pow(n + 1, "p")[:n], out=sums[1:])
        base, inv = sums[starts], _pow(n + 1, "i")[starts]
        long = ends - starts
        out, has = [mix((sums[ends] - base) * inv)], [np.ones(len(starts), bool)]
        for k in prefixes:
            has.append(long >= k)
            out.append(mix((sums[np.minimum(starts + k, n)] - base) * inv + np.uint64(k)))
        yield row, out, has


def hash_text(text: str, lower: bool = True) -> int:
    """The hash that tokens() gives a single word."""
    b = np.frombuffer(text.encode(), np.uint8)
    b = _LOW[b] if lower else b
    return int(hashes(b, np.array([0]), np.array([len(b)]))[0])


def code_points(buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's characters as numbers, and each piece's first character."""
    lead = (buf & np.uint8(0xC0)) != np.uint8(0x80)
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), before[first]


def char_grams(chars: np.ndarray, first: np.ndarray, sizes: tuple[int, ...], within_words: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: (size, start of each n-gram, its hash). With within_words an n-gram may have whitespace only
    as its first or last character, which then marks the word's border; none crosses a piece's bounds."""
    n = len(chars)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    c = np.where(space, np.uint32(32), chars).astype(np.uint64) + np.uint64(1)
    bar = np.zeros(n + 1, np.int32)
    edge = np.zeros(n + 1, np.int32)
    edge[np.minimum(first, n)] = 1
    edge = np.cumsum(edge)
    np.cumsum(space, out=bar[1:])
    h = c.copy()
    for k in range(2, max(sizes) + 1):
        if n < k:
            return
        h = h[: n - k + 1] * _P + c[k - 1 :]
        if k not in sizes:
            continue
        ok = edge[: n - k + 1] == edge[k - 1 : n]
        if within_words:
            ok &= (bar[k - 1 : n] - bar[1 : n - k + 2] == 0) if k > 2 else ~(space[:-1] & space[1:])
        at = np.flatnonzero(ok)
        yield k, at, mix(h[at] + np.uint64(k))
