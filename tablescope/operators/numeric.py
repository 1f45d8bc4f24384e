"""Distributions of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import col, doubles, merge_nan, numeric_columns, profiled, rows_from, small_frame
from ..functions.normality import with_normality
from ..plans.moments import adjusted_kurtosis, adjusted_skew, moments
from ..plans.quantiles import column_quantiles, sketched_quantiles
from ..plans.shared import is_shared

QUARTILES = (0.25, 0.5, 0.75)


def _quartile_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    q = column_quantiles(df, cols, QUARTILES)
    return small_frame(
        df.sparkSession, [(c, *[q[c][p] for p in QUARTILES]) for c in cols],
        "column string, p25 double, p50 double, p75 double",
    )


def numeric_describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, mean, sd, min, p25, p50, p75, max)"""
    cols = numeric_columns(df, cols)
    return moments(df, cols).join(_quartile_rows(df, cols), "column").select(
        "column", "n", "mean", "sd", "min", "p25", "p50", "p75", "max"
    )


def skewness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, skew)"""
    return moments(df, cols).select("column", "n", adjusted_skew(F.col("n"), F.col("g1")).alias("skew"))


def kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, kurt): excess kurtosis"""
    return moments(df, cols).select("column", "n", adjusted_kurtosis(F.col("n"), F.col("g2")).alias("kurt"))


def quantiles(
    df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = K.QUANTILES, exact: bool = True
) -> DataFrame:
    """(column, q, value, exact); ``exact=False`` is one scan of the sketch alone."""
    cols = numeric_columns(df, cols)
    if exact:
        found = column_quantiles(df, cols, probs)
        rows = [(c, float(q), found[c][float(q)], True) for c in cols for q in probs]
        return small_frame(df.sparkSession, rows, "column string, q double, value double, exact boolean")
    found = sketched_quantiles(df, cols, probs)
    rows = [(c, float(q), found[c][j] if found[c] else None, False) for c in cols for j, q in enumerate(probs)]
    return small_frame(df.sparkSession, rows, "column string, q double, value double, exact boolean")


def nonpositive_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, nonpositive, zeros, negatives)"""
    return moments(df, cols).select("column", "n", "nonpositive", "zeros", "negatives")


def shape_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, skew, kurt, skewed, heavy_tailed, correlation): which correlation suits the column."""
    n, skew, kurt = F.col("n"), F.col("skew"), F.col("kurt")
    skewed = F.coalesce(F.abs(skew) > K.SKEW_CUT, F.lit(False))
    heavy = F.coalesce(kurt > K.HEAVY_TAIL_KURTOSIS, F.lit(False))
    base = with_normality(moments(df, cols).select("column", "n", "g1", "g2")).select(
        "column", "n", adjusted_skew(n, F.col("g1")).alias("skew"), adjusted_kurtosis(n, F.col("g2")).alias("kurt"), "k2"
    )
    normal = F.coalesce(F.exp(-F.col("k2") / 2) > K.NORMAL_P, F.lit(False))
    return base.select(
        "column", "n", "skew", "kurt", skewed.alias("skewed"), heavy.alias("heavy_tailed"),
        F.when(normal & ~skewed & ~heavy, "pearson").otherwise("spearman").alias("correlation"),
    )


def value_range_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max)"""
    wide = doubles(df, cols).agg(*[f(col(c)).alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("a", F.min), ("b", F.max))])
    return rows_from(wide, [(F.lit(c), F.col(f"a{i}"), F.col(f"b{i}")) for i, c in enumerate(cols)], ["column", "min", "max"])


def value_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max) of numbers, texts and dates, compared in their own type and shown as text; nothing is rounded.

    NaN counts as missing; a column without values has null ends."""
    cols = list(cols if cols is not None else profiled(df))
    at = {f"{t}{i}": f(col(c)).cast("string").alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("a", F.min), ("b", F.max))}
    wide = merge_nan(df.select(*[col(c) for c in cols])).agg(*at.values())
    return rows_from(wide, [(F.lit(c), F.col(f"a{i}"), F.col(f"b{i}")) for i, c in enumerate(cols)], ["column", "min", "max"])


def ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """{column: (min, max)} on the driver, two numbers per column."""
    found = moments(df, cols) if is_shared(df) else value_range_check(df, cols)
    return {r["column"]: (r["min"], r["max"]) for r in found.select("column", "min", "max").collect()}


def bin_of(value: Column, lo: float, hi: float, k: int) -> Column:
    """Zero-based equal-width bin; the last bin is closed on the right."""
    width = (hi - lo) / k
    if width == 0:
        return F.when(value.isNotNull(), 0).cast("int")
    return F.least(F.lit(k - 1), F.floor((value - F.lit(lo)) / F.lit(width)).cast("int"))


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """(column, bin, lo, hi, n) with empty bins present; a constant column has one bin."""
    cols = numeric_columns(df, cols)
    spans = {c: r for c, r in ranges(df, cols).items() if r[0] is not None}
    frame, entries, grid = doubles(df, cols), [], []
    for c, (lo, hi) in spans.items():
        k = bins if hi > lo else 1
        entries += [F.lit(c), bin_of(col(c), lo, hi, k)]
        width = (hi - lo) / k
        grid += [(c, i, lo + i * width, hi if i == k - 1 else lo + (i + 1) * width) for i in range(k)]
    edges = small_frame(df.sparkSession, grid, "column string, bin int, lo double, hi double")
    if not spans:
        return edges.withColumn("n", F.lit(0).cast("bigint"))
    counts = (
        frame.select(F.stack(F.lit(len(spans)), *entries).alias("column", "bin"))
        .where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))
    )
    return edges.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")
    )


def boxplot_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, p25, p50, p75, whisker_lo, whisker_hi, fliers)"""
    cols = numeric_columns(df, cols)
    q = column_quantiles(df, cols, QUARTILES)
    cols = [c for c in cols if q[c][0.5] is not None]
    names = ["column", "p25", "p50", "p75", "whisker_lo", "whisker_hi", "fliers"]
    if not cols:
        return small_frame(df.sparkSession, [], ", ".join(f"{n} {t}" for n, t in zip(names, ["string"] + ["double"] * 5 + ["bigint"])))
    parts, entries = [], []
    for i, c in enumerate(cols):
        low, high = fences(q[c][0.25], q[c][0.75])
        inside = col(c).between(low, high)
        parts += [
            F.min(F.when(inside, col(c))).alias(f"a{i}"), F.max(F.when(inside, col(c))).alias(f"b{i}"),
            F.count_if(~inside).alias(f"f{i}"),
        ]
        entries.append((F.lit(c), *[F.lit(q[c][p]) for p in QUARTILES], F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"f{i}")))
    return rows_from(doubles(df, cols).agg(*parts), entries, names)


def fences(q1: float, q3: float, k: float = K.IQR_MULTIPLIER) -> tuple[float, float]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)
