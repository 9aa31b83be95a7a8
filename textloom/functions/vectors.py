"""Vector columns and the built-in hashing embedder."""

from __future__ import annotations

import math
import re
import zlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rounded(x: np.ndarray, digits: int = 10) -> np.ndarray:
    """Doubles rounded as Spark's ``round`` does: half up, by their shortest decimal form."""
    scaled = np.abs(x) * 10.0**digits
    with np.errstate(invalid="ignore"):
        out = np.where(scaled < 2**53, np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x), x)
        doubtful = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)
    for k in doubtful:
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows in double precision, and which of them are ``size`` long without nulls; the others are zero."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    whole = lengths == size
    out = np.zeros((len(whole), size))
    values = pa.compute.list_flatten(vectors.filter(pa.array(whole))).cast(pa.float64())
    gaps = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1) if size else np.zeros(whole.sum(), bool)
    out[whole] = np.where(gaps[:, None], 0.0, values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size))
    whole[np.flatnonzero(whole)[gaps]] = False
    return out, whole


def hash_embedder(size: int = 64):
    """A deterministic embedding of texts: signed hashed word counts, of unit length (zero for no words)."""

    def embed_one(text: str | None) -> np.ndarray:
        h = np.array([zlib.crc32(word.encode()) for word in re.findall(r"[^\W\d_]+", (text or "").lower())], np.int64)
        out = np.bincount(h % size, weights=np.where(h >> 31, 1.0, -1.0), minlength=size).astype(np.float32)
        norm = math.sqrt(float(out @ out))
        return out / norm if norm else out

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(embed_one)

    return embed


def register_embedder(spark: SparkSession, name: str = "embed", size: int = 64) -> None:
    """Make the embedder callable in SQL."""
    spark.udf.register(name, hash_embedder(size))
