"""Bounded samples by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.thresholds import hash63


def by_hash(df: DataFrame, n: int, *keys: Column | str, seed: str = "") -> DataFrame:
    """At most ``n`` rows: those of the smallest hashes of ``keys``, the same however rows are partitioned.

    Only rows under a hash that some 2 n rows are expected to have are ever sorted, so that tasks hand on few rows each.
    Should fewer than n rows lie under it, those are the sample.
    """
    total = df.count()
    h = hash63(*[F.col(k) if isinstance(k, str) else k for k in keys], seed=seed)
    if total > 2 * n:
        df = df.filter(h < int((1 << 63) * (2 * n / total)))
    return df.orderBy(h).limit(n)
