"""Column functions on vectors; all arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Scaled to length 1; null for a vector of length 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n))


def fit_dim(v: Column, dim: int) -> Column:
    """Padded with zeros, or truncated and normalised again."""
    padded = F.concat(as_double(v), F.array_repeat(F.lit(0.0), dim))
    return F.when(F.size(v) > dim, l2_normalize(F.slice(as_double(v), 1, dim))).otherwise(F.slice(padded, 1, dim))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def search_score(cos: Column) -> Column:
    """A cosine as a score from 0 to 1."""
    return (1 + cos) / 2


def has_dim(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def merge(df: DataFrame, by: str, vector: str, how: Callable[[Column], Column]) -> DataFrame:
    """(by, pos, value): elementwise aggregate of the vectors of a group; map-side combined per component."""
    parts = df.select(by, F.posexplode(as_double(F.col(vector))).alias("pos", "x"))
    return parts.groupBy(by, "pos").agg(how(F.col("x")).alias("value"))


def merged_unit(df: DataFrame, by: str, vector: str, how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(by, vector): the merged vectors of each group as arrays of length 1; null where they cancel out."""
    whole = merge(df, by, vector, how).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("parts"))
    return whole.select(by, l2_normalize(F.col("parts.value")).alias("vector"))


def merge_list(vectors: Column) -> Column:
    """Mean of an array of vectors, normalised; null without vectors."""
    n = F.size(vectors)
    total = F.aggregate(
        F.slice(vectors, F.lit(2), F.greatest(n - 1, F.lit(0))), as_double(F.get(vectors, F.lit(0))), lambda acc, v: F.zip_with(acc, as_double(v), lambda x, y: x + y))
    return F.when(n > 0, l2_normalize(total))
