"""Exact nearest vectors by cosine; ties go to the smaller id.

The query is normalised once and norms are floored, so a zero vector scores 0. The sort is a
``TakeOrderedAndProject``: each task keeps k rows, nothing else moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_NORM = 1e-10


def _double(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(vectors: DataFrame, query: list[float], embedding: str = "embedding") -> Column:
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    if length == 0:
        raise ValueError("the query vector is zero")
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    return dot(vectors[embedding], unit) / F.greatest(norm(vectors[embedding]), F.lit(LEAST_NORM))


def top_k(vectors: DataFrame, query: list[float], k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    scored = vectors.select(key, cosine(vectors, query, embedding).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_per_partition(vectors: DataFrame, query: list[float], k: int, partition: str, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k best of each partition; a window with a row limit keeps k rows per task and partition before the shuffle."""
    best = Window.partitionBy(partition).orderBy(F.desc("score"), key)
    scored = vectors.select(partition, key, cosine(vectors, query, embedding).alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def merged_top_k(parts: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    return parts.orderBy(F.desc("score"), key).limit(k)
