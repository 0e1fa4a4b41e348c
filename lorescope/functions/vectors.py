"""Vectors as arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TOKEN_BREAKS = r"[^\p{L}\p{N}]+"


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(size, F.lit(0.0)), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    scaled = F.arrays_zip(v.alias("x"), F.array_repeat(size, F.size(v)).alias("s"))
    return F.transform(scaled, lambda p: (p["x"].cast("double") / p["s"]))


def bucket(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def _unit_counts(dim: int):
    """Arrays of slot numbers to their counts at length 1, a whole Arrow batch at a time."""

    @F.arrow_udf("array<double>")
    def count(slots: pa.Array) -> pa.Array:
        sizes, n = slots.value_lengths().to_numpy(zero_copy_only=False), len(slots)
        at = np.repeat(np.arange(n), sizes) * dim + slots.flatten().to_numpy()
        counts = np.bincount(at, minlength=n * dim).reshape(n, dim).astype("f8")
        counts /= np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-300)
        return pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype="i4"), counts.ravel())

    return count


def hash_embed(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """df with `vector`, counts of hashed tokens at length 1; a text without tokens has zeros. No network and no model."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKEN_BREAKS), "")
    return df.withColumn("vector", _unit_counts(dim)(F.transform(tokens, lambda t: bucket(t, dim))))
