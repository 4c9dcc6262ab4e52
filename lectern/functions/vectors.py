"""Vector functions over array<float>, computed in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Of length one; zero and non-finite vectors stay."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def valid(a: Column) -> Column:
    """Not empty, and finite."""
    return (F.size(a) > 0) & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def similarity_of_distance(distance: Column) -> Column:
    """1 - d² / 2 within [-1, 1]: the cosine of unit vectors at that distance."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def sign_cell(vector: Column, bits: int) -> Column:
    """A number whose bits are the signs of the first dimensions."""
    signs = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i)).otherwise(0.0))
    return F.aggregate(signs, F.lit(0.0), lambda s, x: s + x).cast("long")


def to_bytes(vector: Column) -> Column:
    """Little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def of(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return of(vector)


def from_bytes(blob: Column) -> Column:
    """The vector of little-endian 32-bit floats; bytes that are none give null."""

    @F.pandas_udf("array<float>")
    def of(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)

    return of(blob)
