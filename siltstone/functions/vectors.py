"""Vector arithmetic in column functions, in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is tiny."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 1e-12), dot(a, b) / size).otherwise(F.lit(0.0))


def dimensions(df: DataFrame, vector: str) -> int:
    """The length of the longest vector of `df`: one narrow pass over one column."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def mean_vector(vector: str, dims: int, weight: Column | None = None) -> Column:
    """Aggregate: the (weighted) mean of a group's vectors of `dims` dimensions, one sum for each, so partial sums shrink rows before the exchange. Places that shorter vectors do not have count as missing."""
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(F.get(vector, F.lit(k)) * w) / F.sum(w) for k in range(dims)])
