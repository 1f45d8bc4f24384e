"""Samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col


def lowest_by_hash(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """The n rows whose key has the lowest hash.

    A plain sorted limit keeps n rows per task and merges them in one place.  On a large table a threshold on the hash first
    leaves about four times n rows in all; if equal keys make that too few, the plain way is taken."""
    order = F.xxhash64(F.lit(seed), *[col(k) for k in key])
    total = df.count()
    if total > 100 * n:
        limit = int(-(2 ** 63) + 2 ** 64 * (4 * n / total))
        few = df.where(order < F.lit(limit))
        if few.limit(n).count() == n:
            df = few
    return df.orderBy(order, *[col(k) for k in key]).limit(n)
