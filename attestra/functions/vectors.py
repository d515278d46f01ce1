"""Vectors as array<double> columns: hashed embeddings, cosine."""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSION = 24
#: Words whose vectors a worker remembers.
CACHE_WORDS = 200_000


class WordVectors:
    """Words by number, and for each a row: the bytes of its SHA-256 / 255 - 0.5."""

    def __init__(self, dimension: int):
        self.at = np.arange(dimension) % 32
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, dimension))

    def known(self, words: list[str]) -> np.ndarray:
        """The rows of words; new ones are hashed together."""
        if len(self.number) >= CACHE_WORDS:
            self.number.clear()
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            n = len(number)
            made = np.frombuffer(b"".join([sha256(w.encode()).digest() for w in new]), np.uint8).reshape(-1, 32)[:, self.at] / 255.0 - 0.5
            if n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:n], np.zeros((n + len(new) + 1024, len(self.at)))])
            self.rows[n : n + len(new)] = made
            number.update(zip(new, range(n, n + len(new))))
        return self.rows[np.fromiter(map(number.__getitem__, words), np.intp, len(words))]

    def __getitem__(self, word: str) -> np.ndarray:
        return self.known([word])[0]


@cache
def word_vectors(dimension: int) -> WordVectors:
    """The worker's own, kept from batch to batch."""
    return WordVectors(dimension)


def embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Per word (as often as it stands) the vector of its hash, summed, at unit length, 8 decimals; zeros without words, null for null.

    In Arrow batches: each distinct word is hashed once a worker, and sums run over whole arrays.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def embedded(texts: pd.Series) -> pd.Series:
        vectors = word_vectors(dimension)

        def one(t: str | None) -> np.ndarray | None:
            if t is None:
                return None
            words = t.lower().split()
            total = vectors.known(words).sum(axis=0) if words else np.zeros(dimension)
            n = np.sqrt((total * total).sum())
            return np.round(total / n, 8) if n else total

        return texts.map(one, na_action=None)

    return embedded(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 for empty vectors and those of length 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    d = norm(x) * norm(y)
    return F.when((n <= 0) | (d == 0), F.lit(0.0)).otherwise(dot(x, y) / F.when(d == 0, 1.0).otherwise(d))
