"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.functions.text import coded_tokens, col, let

#: Texts that are embedded at a time.
TEXTS = 256


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product over the shorter length."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either norm is 0."""
    return let(norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size).otherwise(0.0))


def l2_normalize(a: Column | str) -> Column:
    """A zero vector stays as it is."""
    return let(F.struct(col(a).alias("v"), norm(a).alias("n")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))


class _TokenRows:
    """Digests of tokens, each hashed once while the table lasts and held as bytes; starts anew when full."""

    def __init__(self, width: int, limit: int = 100_000):
        self.width, self.limit = width, limit
        self.place: dict[str | bytes, int] = {}
        self.held = bytearray()

    @property
    def rows(self) -> np.ndarray:
        return np.frombuffer(self.held, np.uint8).reshape(-1, self.width)

    def places_of(self, terms: list[str] | list[bytes]) -> np.ndarray:
        if len(self.place) > self.limit:
            self.place.clear()
            self.held = bytearray()
        for t in terms:
            if t not in self.place:
                self.held += sha256(t if isinstance(t, bytes) else t.encode()).digest()[: self.width]
                self.place[t] = len(self.place)
        return np.fromiter(map(self.place.__getitem__, terms), np.int64, len(terms))

    def sums(self, counts: np.ndarray, codes: np.ndarray, terms: list[str] | list[bytes]) -> np.ndarray:
        """Of texts with so many tokens each, given by codes of terms: the sums of byte / 255 - 0.5, of whole numbers up to the last step, so the order of tokens does not matter."""
        at, out = self.places_of(terms), np.zeros((len(counts), self.width), np.int64)
        if len(codes):
            # a text without tokens has no place of its own to sum from
            first = (np.cumsum(counts) - counts)[counts > 0]
            out[counts > 0] = np.add.reduceat(self.rows[at[codes]], first, axis=0, dtype=np.int64)
        return out / 255.0 - 0.5 * counts[:, None]

    def sum_of(self, tokens: list[str] | list[bytes]) -> np.ndarray:
        return self.sums(np.array([len(tokens)]), np.arange(len(tokens)), tokens)[0]


@lru_cache(maxsize=2)
def _token_rows(width: int) -> _TokenRows:
    return _TokenRows(width)


def hashing_vectors(lowered: pa.Array, dim: int = C.HASH_DIM) -> np.ndarray:
    """Over the tokens of each lower-cased text the sums of SHA-256 byte / 255 - 0.5, unit length; zeros without tokens. SHA-256 has 32 bytes; later positions repeat them."""
    counts, codes, terms = coded_tokens(lowered)
    v = np.resize(_token_rows(min(dim, 32)).sums(counts, codes, terms.to_pylist()).T, (dim, len(counts))).T
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def hashing_vector(lowered: str | None, dim: int = C.HASH_DIM) -> np.ndarray:
    return hashing_vectors(pa.array([lowered], pa.string()), dim)[0]


def hashing_embedding(text: Column | str, dim: int = C.HASH_DIM) -> Column:
    """The text's hashing_vector(); lower-cased in the JVM, then some texts at a time in Arrow batches, so nothing is shuffled.

    Only the first 32 positions differ; later ones repeat them.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([v for at in range(0, len(texts), TEXTS) for v in hashing_vectors(pa.array(texts[at : at + TEXTS], pa.string(), from_pandas=True), dim)], dtype=object)

    return embed(F.lower(col(text)))
