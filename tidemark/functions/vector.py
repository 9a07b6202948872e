"""Vectors as arrays, computed in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def guarded_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for other lengths and vectors of norm 0."""
    sound = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    lengths = norm(a) * norm(b)
    return F.when(sound & (lengths > 0), dot(a, b) / lengths).otherwise(-1.0)


def vector_mean(vectors: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """The elementwise mean of each key's vectors: partial sums by position before the shuffle."""
    places = vectors.select(*keys, F.posexplode(column).alias("place", "value"))
    means = places.groupBy(*keys, "place").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "mean")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda x: x["mean"]).alias("embedding"))
