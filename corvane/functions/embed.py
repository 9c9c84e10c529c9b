"""Text encoders. The default one hashes terms, needs no model, and gives the same numbers in any SQL engine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = re.compile("[a-z0-9]+")
#: Terms that a worker remembers, none longer than 64 characters.
REMEMBER = 500_000


class Embedder(Protocol):
    dimension: int

    def column(self, t: Column) -> Column:
        """array<double> of a text column."""

    def one(self, t: str) -> list[float]:
        """Vector of a query text."""


class HashEmbedder:
    """Term frequencies in buckets: first four hex digits of the term's MD5, modulo the dimension. Terms are hashed once in a worker while they fit its memory."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def column(self, t: Column) -> Column:
        dimension = self.dimension

        @F.arrow_udf("array<double>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets = Buckets(dimension)
            for texts in batches:
                yield pa.array([buckets.vector(x.as_py() or "") for x in texts], pa.list_(pa.float64()))

        return encode(t.cast("string"))

    def one(self, t: str) -> list[float]:
        return Buckets(self.dimension).vector(t).tolist()


class Buckets(dict):
    """Term to bucket; forgets everything when it is full."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, term: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        out = int(hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()[:4], 16) % self.dimension
        if len(term) <= 64:
            self[term] = out
        return out

    def vector(self, text: str) -> np.ndarray:
        terms = TERMS.findall(text.lower())
        return np.bincount(np.fromiter(map(self.__getitem__, terms), np.int64, len(terms)), minlength=self.dimension).astype(float)


class ModelEmbedder:
    """Any model that encodes lists of texts, in Arrow batches. load runs once in each process, for all columns and queries."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int):
        self.load, self.dimension, self._model = load, dimension, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}  # workers load their own

    def model(self) -> Callable[[list[str]], np.ndarray]:
        if self._model is None:
            self._model = self.load()
        return self._model

    def column(self, t: Column) -> Column:
        own = self

        @F.arrow_udf("array<double>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                got = np.asarray(own.model()([x or "" for x in texts.to_pylist()]), dtype=float).reshape(len(texts), own.dimension)
                yield pa.array(list(got), pa.list_(pa.float64()))

        return encode(t.cast("string"))

    def one(self, t: str) -> list[float]:
        return [float(x) for x in self.model()([t])[0]]
