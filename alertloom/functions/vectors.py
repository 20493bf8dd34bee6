"""Vector expressions over ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x, F.sqrt)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is. The norm is taken once, not per element."""
    wide = v.cast("array<double>")
    length = F.array(F.coalesce(F.nullif(norm(wide), F.lit(0.0)), F.lit(1.0)))
    return F.transform(length, lambda n: F.transform(wide, lambda x: x / n))[0]


def linkable(vectors: DataFrame) -> DataFrame:
    """The vectors that can be similar to anything: those that are not zero."""
    return vectors.where(F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit) of the linkable vectors."""
    return linkable(vectors).select("vec_id", l2_normalize(F.col("embedding")).alias("unit"))
