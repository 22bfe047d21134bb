"""Murmur3 (x86, 32 bits, seed 0) over distinct terms, vectorised by term length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: The index range of lexical terms: above all concept indices, below 2**31 - 1.
LEXICAL_BASE = 1 << 27
LEXICAL_SPAN = (1 << 31) - 1 - LEXICAL_BASE

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(terms: list[str]) -> np.ndarray:
    """The signed hash of each term's UTF-8 bytes; terms of one length go together."""
    raw = [t.encode() for t in terms]
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros(len(raw), np.int32)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        b = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n).astype(np.uint32)
        h = np.zeros(len(at), np.uint32)
        whole = n // 4
        for k in range(whole):
            block = b[:, 4 * k] | b[:, 4 * k + 1] << np.uint32(8) | b[:, 4 * k + 2] << np.uint32(16) | b[:, 4 * k + 3] << np.uint32(24)
            h = _rotate(h ^ (_rotate(block * _C1, 15) * _C2), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            tail = np.zeros(len(at), np.uint32)
            for k in range(n - 1, 4 * whole - 1, -1):
                tail = tail << np.uint32(8) | b[:, k]
            h = h ^ (_rotate(tail * _C1, 15) * _C2)
        h = h ^ np.uint32(n)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        out[at] = (h ^ (h >> np.uint32(16))).view(np.int32)
    return out


@pandas_udf(LongType())
def lexical_index(term: pd.Series) -> pd.Series:
    return pd.Series(LEXICAL_BASE + np.abs(murmur3(term.tolist()).astype(np.int64)) % LEXICAL_SPAN)
