"""Quantile sketches (KLL) of many columns in one scan, merged in two levels.

A sketch per task would otherwise be merged by a single reducer; at a hundred thousand tasks that is the slowest part of the job.
Tasks are grouped by partition number first, so the last step merges ``SALTS`` sketches per column whatever the input size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, functions as F

from ..functions.columns import col

SALTS = 64
# Sketch sizes: K_CUTS is enough to balance buckets, K_RANKS brackets a rank within a few ten-thousandths of the rows.
K_CUTS, K_RANKS = 4_096, 32_768


def rank_error(k: int) -> float:
    """Normalised rank error of a KLL sketch at 99 % confidence (published constant and exponent)."""
    return 2.296 / k ** 0.9021


def sketch(df: DataFrame, probs: Mapping[str, Sequence[float]], k: int) -> Row:
    """One row with n<i>, lo<i>, hi<i> and q<i> (the sketched quantiles) for the i-th column; columns must be double."""
    cols = list(probs)
    first = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt")).agg(*[
        x for i, c in enumerate(cols) for x in (
            F.count(col(c)).alias(f"n{i}"), F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"),
            F.kll_sketch_agg_double(col(c), F.lit(k)).alias(f"s{i}"))
    ])
    merged = first.agg(*[
        x for i in range(len(cols)) for x in (
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"),
            F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")), F.lit(k)).alias(f"s{i}"))
    ])
    asked = [F.array(*[F.lit(float(q)) for q in probs[c]]) for c in cols]
    return merged.select(*[
        x for i in range(len(cols)) for x in (
            f"n{i}", f"lo{i}", f"hi{i}",
            F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), asked[i])).alias(f"q{i}"))
    ]).first()
