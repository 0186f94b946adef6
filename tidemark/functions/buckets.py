"""Equi-depth buckets: which interval of a sorted array of bounds a value falls in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile_bounds(value: Column | str, buckets: int, accuracy: int = 10000) -> Column:
    """Aggregate: the ``buckets`` - 1 inner bounds (approximate quantiles; a mergeable sketch)."""
    return F.percentile_approx(value, [i / buckets for i in range(1, buckets)], accuracy)


def bucket_of(value: Column | str, bounds: Column | str, buckets: int) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by halving steps (``buckets`` is a power of two)."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    x = F.col(value) if isinstance(value, str) else value
    steps = [1 << k for k in reversed(range(buckets.bit_length() - 1))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, step: at + F.when(F.get(bounds, at + step - 1) < x, step).otherwise(F.lit(0)))
