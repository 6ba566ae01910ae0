"""Hashes and vectors as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex; null stays null."""
    return F.sha2(text, 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def mock_embedding(text: Column, dimensions: int = 8) -> Column:
    """A deterministic unit vector: the text's SHA-256, read as big-endian 32-bit words in
    turn, each mapped to [-1, 1). A zero vector would stay as it is. Null text gives null."""

    def part(digest: Column, i: int) -> Column:
        word = F.conv(F.substring(digest, 1 + 8 * (i % 8), 8), 16, 10).cast("double")
        return word / F.lit(4294967296.0) * 2.0 - 1.0

    def unit(raw: Column) -> Column:
        return _let(F.sqrt(dot(raw, raw)), lambda norm: F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(x)))

    raw = _let(F.sha2(text, 256), lambda digest: F.array(*[part(digest, i) for i in range(dimensions)]))
    return F.when(text.isNotNull(), _let(raw, unit))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, added up in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length. Both must have the same number of dimensions."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def to_float32(vector: Column) -> Column:
    """The stored form of a vector."""
    return vector.cast("array<float>")


def pack_bytes(vector: Column) -> Column:
    """A vector as the bytes of its floats, little endian; null stays null."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(to_float32(vector))


def unpack_bytes(blob: Column) -> Column:
    """The vector that the bytes hold. A length that is no multiple of four is an error."""

    def one(data: bytes | None) -> np.ndarray | None:
        if data is None:
            return None
        if len(data) % 4:
            raise ValueError("the bytes of a vector must be a multiple of four")
        return np.frombuffer(data, "<f4")

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(one)

    return unpack(blob)
