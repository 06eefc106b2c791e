"""Similarity of small descriptors: distances, hashes, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of one length; null for different or no lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def descriptor_distance(gray: tuple[Column, Column], rgb: tuple[Column, Column], rgb_weight: float = 0.15) -> Column:
    return mean_squared_error(*gray) + rgb_weight * mean_squared_error(*rgb)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(gray: Column) -> Column:
    """Bits of the values that reach their mean, the first value in the highest of 64 bits; of equal values all."""
    mean = F.aggregate(gray, F.lit(0.0), lambda s, x: s + x) / F.size(gray)
    return F.aggregate(gray, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x >= mean, 1).otherwise(0).cast("long")))


def recall_at(ranked: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """Shares of queries whose expected candidate has a rank of at most k; null ranks miss. Rounded half to even."""
    hit = lambda k: F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))
    return ranked.agg(F.count(F.lit(1)).alias("n_queries"), *[F.bround(F.avg(hit(k)), 4).alias(f"recall_at_{k}") for k in ks])
