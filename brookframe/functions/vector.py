"""Vector operators as column expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _array(v: Column | Sequence[float]) -> Column:
    return (v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])).cast("array<double>")


def dot(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(_array(a), _array(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    """Null for a zero vector or different lengths."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_array(a), _array(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def vector_search(df: DataFrame, path: str, query: Sequence[float], limit: int, id_col: str) -> DataFrame:
    """The rows with the highest cosine similarity to one vector, with `score`; ties to the smaller id. Each task keeps its best."""
    return df.withColumn("score", cosine_similarity(F.col(path), query)).where("score is not null").orderBy(F.desc("score"), id_col).limit(limit)
