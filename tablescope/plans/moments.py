"""All moments, extremes and sign counts of the numeric columns in one scan and one small shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import long_doubles, numeric_columns, with_all_columns
from .shared import is_shared, on_driver, remember

COUNTS = ("rows", "n", "nulls", "nonpositive", "zeros", "negatives")


def moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, n, nulls, nonpositive, zeros, negatives, mean, sd, sd_pop, min, max, g1, g2).

    g1 and g2 are the population skewness and excess kurtosis; see ``adjusted_skew`` and ``adjusted_kurtosis``."""
    cols = numeric_columns(df, cols)
    known = numeric_columns(df)
    if is_shared(df) and set(cols) <= set(known):
        return remember(df, "moments", lambda: on_driver(_moments(df, known))).where(F.col("column").isin(cols))
    return _moments(df, cols)


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    v = F.col("value")
    core = long_doubles(df, cols).groupBy("column").agg(
        F.count("*").alias("rows"),
        F.count(v).alias("n"),
        F.count_if(v <= 0).alias("nonpositive"),
        F.count_if(v == 0).alias("zeros"),
        F.count_if(v < 0).alias("negatives"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.stddev_pop(v).alias("sd_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("g1"),
        F.kurtosis(v).alias("g2"),
    )
    core = core.withColumn("nulls", F.col("rows") - F.col("n"))
    return with_all_columns(core, cols).select(
        "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        "mean", "sd", "sd_pop", "min", "max", "g1", "g2",
    )


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Bias-adjusted sample skewness; null below three values."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-adjusted sample excess kurtosis; null below four values."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
