"""Where values are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.columns import col, merge_nan, profiled
from .numeric import bin_of, ranges
from .overview import null_counts


def missing_ranking(df: DataFrame) -> DataFrame:
    """(column, nulls, null_share), most missing first."""
    return null_counts(df).orderBy(F.desc("nulls"), "column")


def missing_heatmap(df: DataFrame, key: str, bins: int = 20) -> DataFrame:
    """(bin, column, rows, nulls, null_share): missing share per slice of the key and column.

    A row-by-column matrix grows with the data; slices of a numeric key keep the picture at bins x columns.  Rows without a key
    are a slice of their own, whose bin is null."""
    lo, hi = ranges(df, [key])[key]
    cols = [c for c in profiled(df) if c != key]
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    clean = merge_nan(df.select(*[col(c) for c in (key, *cols)]))
    cut = clean.withColumn("_bin", F.when(col(key).isNotNull(), bin_of(col(key).cast("double"), lo, hi, bins)))
    wide = cut.groupBy(F.col("_bin").alias("bin")).agg(F.count("*").alias("rows"), *[F.count_if(col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    long = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(cols)])
    return wide.select("bin", "rows", F.inline(long)).select(
        "bin", "column", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_share")
    )


def high_missing_columns(df: DataFrame, share: float = K.HIGH_NULL_SHARE) -> DataFrame:
    """(column, nulls, null_share) above the share."""
    return null_counts(df).where(F.col("null_share") > share)
