"""Frequencies and cardinality of categorical (or any) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.columns import CATEGORICAL, columns_of, small_frame
from ..plans.frequency import distinct_summary, frequencies, most_frequent, top_values, value_text
from .overview import dataset_shape, null_counts


def _counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return frequencies(df, cols).select("column", value_text(df, cols).alias("value"), "n")


def _named(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols else columns_of(df, CATEGORICAL)


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, top: int = K.TOP_CATEGORIES) -> DataFrame:
    """(column, value, n, rank): the most frequent values, ties in value order.

    Long texts are never shuffled: they are counted by fingerprint and only the winners are looked up (``top_values``)."""
    names = _named(df, cols)
    if not names:
        return small_frame(df.sparkSession, [], "column string, value string, n bigint, rank int")
    return top_values(df, names, top)


def value_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n, share): share among the non-missing rows; one total per column is joined back."""
    counts = _counts(df, _named(df, cols))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("_total")).alias("share")
    )


def cardinality(df: DataFrame, cols: Sequence[str] | None = None, rsd: float | None = None) -> DataFrame:
    """(column, uniques); with ``rsd`` a sketch of that relative error instead of the exact count."""
    if rsd is None:
        return distinct_summary(df, cols).select("column", "uniques")
    from ..functions.columns import col, merge_nan, profiled, rows_from

    cols = list(cols or profiled(df))
    wide = merge_nan(df).agg(*[F.approx_count_distinct(col(c), rsd).alias(f"_{i}") for i, c in enumerate(cols)])
    return rows_from(wide, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(cols)], ["column", "uniques"])


def cardinality_class(df: DataFrame, cols: Sequence[str] | None = None, low: int = K.LOW_CARDINALITY) -> DataFrame:
    """(column, uniques, class): constant, binary, low, id_like or high."""
    u = F.col("uniques")
    kind = (
        F.when(u <= 1, "constant").when(u == 2, "binary").when(u == F.col("rows"), "id_like")
        .when(u <= low, "low").otherwise("high")
    )
    rows = dataset_shape(df).select("rows")
    return (
        distinct_summary(df, cols).withColumn("rows", rows.scalar()).select("column", "uniques", kind.alias("class"))
    )


def top_value(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): the most frequent value."""
    return most_frequent(df, _named(df, cols)).select("column", F.col("top").alias("value"), F.col("freq").alias("n"))


def category_missing(df: DataFrame) -> DataFrame:
    """(column, nulls, null_share) of the categorical columns."""
    return null_counts(df, columns_of(df, CATEGORICAL))
