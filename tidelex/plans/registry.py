"""Plug-ins: retrievers, datasets, and providers of vectors, lemmas and translations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.vector import unit

PAIRS = {"eng-eng": ("en", "en"), "spa-spa": ("es", "es"), "eng-spa": ("en", "es"), "spa-eng": ("es", "en")}


class Registry:
    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str) -> Callable:
        def add(item):
            if name in self._items:
                raise ValueError(f"{self.kind} {name} is registered already")
            self._items[name] = item
            return item

        return add

    def get(self, name: str):
        if name not in self._items:
            raise KeyError(f"unknown {self.kind} {name}; there are {', '.join(self.names())}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)


retrievers, datasets = Registry("retriever"), Registry("dataset")


class EmbeddingProvider(Protocol):
    dim: int

    def embed(self, texts: DataFrame) -> DataFrame:
        """texts(text) -> (text, x)."""


class HashedGrams:
    """A stand-in for a text encoder: signed hashing of character trigrams, with marks at both ends, to unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: DataFrame) -> DataFrame:
        dim = self.dim

        @pandas_udf("array<float>")
        def of(text: pd.Series) -> pd.Series:
            import zlib

            out = []
            for t in text:
                v, t = np.zeros(dim, np.float32), f"<{t}>"
                for i in range(max(len(t) - 2, 0)):
                    h = zlib.crc32(t[i : i + 3].encode())
                    v[h % dim] += 1 - 2 * (h >> 31)
                out.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
            return pd.Series(out)

        return texts.select("text").distinct().withColumn("x", of("text"))


class DigestVectors:
    """A stand-in whose vectors any engine can work out: the SHA-1 digits of a text, centred, to unit length; 40 places at most."""

    def __init__(self, dim: int = 16):
        if not 0 < dim <= 40:
            raise ValueError("a SHA-1 has 40 digits")
        self.dim = dim

    def embed(self, texts: DataFrame) -> DataFrame:
        places = F.sequence(F.lit(1), F.lit(self.dim))
        # The hash is bound once, not worked out again for each place.
        digits = F.transform(F.array(F.sha1("text")), lambda h: F.transform(places, lambda i: F.conv(F.substr(h, i, F.lit(1)), 16, 10).cast("double") - 7.5))[0]
        return texts.select("text").distinct().withColumn("x", unit(digits))


def guard_test_split(split: str, allowed: bool) -> None:
    """The sealed test split needs an explicit permission."""
    if split == "test" and not allowed:
        raise PermissionError("the test split is sealed")


def pairs_for(supported: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    return {p: PAIRS[p] for p in PAIRS if p in supported}


def translated(queries: DataFrame, table: DataFrame) -> DataFrame:
    """queries(qid, ord, token) word by word through table(src, tgt); words that aren't there stay."""
    return queries.join(table.withColumnRenamed("src", "token"), "token", "left").select("qid", "ord", F.coalesce("tgt", "token").alias("token"))
