"""Feature-engineering advice as tables, and the transforms themselves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import CATEGORICAL, DATETIME, col, columns_of, merge_nan, numeric_columns, small_frame
from ..plans.frequency import distinct_summary
from ..plans.moments import adjusted_skew, moments
from ..plans.quantiles import column_quantiles
from .numeric import bin_of, ranges
from .relations import strong_pairs


def log_candidates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, skew, min, transform, reason)"""
    skew, low = F.col("skew"), F.col("min")
    transform = (
        F.when((skew > K.SKEW_CUT) & (low > 0), "log").when((skew > K.SKEW_CUT) & (low >= 0), "sqrt")
        .when(skew < -K.SKEW_CUT, "reflect").otherwise("none")
    )
    reason = (
        F.when(skew.isNull(), "skew undefined").when(F.abs(skew) <= K.SKEW_CUT, "not skewed")
        .when((skew > K.SKEW_CUT) & (low < 0), "skewed right with negative values")
        .when(skew > K.SKEW_CUT, "skewed right").otherwise("skewed left")
    )
    base = moments(df, cols).select("column", adjusted_skew(F.col("n"), F.col("g1")).alias("skew"), "min")
    return base.withColumn("transform", transform).withColumn("reason", reason)


def transform_skewed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add <c>_log, <c>_log1p and <c>_sqrt; null where the value is outside the domain."""
    new: list[Column] = []
    for c in cols:
        v = F.nanvl(col(c).cast("double"), F.lit(None))
        new += [
            F.when(v > 0, F.log(v)).alias(f"{c}_log"), F.when(v > -1, F.log1p(v)).alias(f"{c}_log1p"),
            F.when(v >= 0, F.sqrt(v)).alias(f"{c}_sqrt"),
        ]
    return df.select("*", *new)


def reflect_transform(df: DataFrame, column: str) -> DataFrame:
    """Add <c>_reflect = log(max + 1 - x) for a left-skewed column."""
    high = ranges(df, [column])[column][1]
    return df.withColumn(f"{column}_reflect", F.log(F.lit(high) + 1 - F.nanvl(col(column).cast("double"), F.lit(None))))


def encoding_advice(df: DataFrame, cols: Sequence[str] | None = None, limit: int = K.ONE_HOT_LIMIT) -> DataFrame:
    """(column, uniques, encoding)"""
    cols = list(cols or columns_of(df, CATEGORICAL))
    return distinct_summary(df, cols).select(
        "column", "uniques", F.when(F.col("uniques") < limit, "one_hot").otherwise("target_or_frequency").alias("encoding")
    )


def one_hot(df: DataFrame, column: str, limit: int = K.ONE_HOT_LIMIT) -> DataFrame:
    """Add one 0/1 column per category; refuses a column with ``limit`` or more categories."""
    found = merge_nan(df.select(col(column))).where(col(column).isNotNull()).distinct().limit(limit).collect()
    if len(found) >= limit:
        raise ValueError(f"{column} has {limit} or more categories; use frequency_encode or target_encode")
    names = sorted((r[0] for r in found), key=str)
    return df.select("*", *[F.coalesce((col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in names])


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """Add <c>_freq, the share of the value among the non-missing rows."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n"))
    shares = counts.select(col(column), (F.col("_n") / total.scalar()).alias(f"{column}_freq"))
    return df.join(shares, column, "left").select(*[col(c) for c in df.columns], col(f"{column}_freq"))


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """Add <c>_target: the mean of the target per value, drawn towards the overall mean by ``smoothing`` rows."""
    t = F.nanvl(col(target).cast("double"), F.lit(None))
    known = df.where(col(column).isNotNull())
    sums = known.groupBy(col(column)).agg(F.sum(t).alias("_s"), F.count(t).alias("_n"))
    overall = known.agg(F.avg(t)).scalar()
    mean = F.try_divide(F.col("_s") + F.lit(float(smoothing)) * overall, F.col("_n") + F.lit(float(smoothing)))
    coded = sums.select(col(column), mean.alias(f"{column}_target"))
    return df.join(coded, column, "left").select(*[col(c) for c in df.columns], col(f"{column}_target"))


def datetime_features(df: DataFrame, ts: str) -> DataFrame:
    """Add year, month, day_of_week (0 = Monday), hour and is_weekend."""
    t = col(ts)
    return df.select(
        "*", F.year(t).alias(f"{ts}_year"), F.month(t).alias(f"{ts}_month"), F.weekday(t).alias(f"{ts}_day_of_week"),
        F.hour(t.cast("timestamp_ntz")).alias(f"{ts}_hour"), (F.weekday(t) >= 5).alias(f"{ts}_is_weekend"),
    )


def bin_equal_width(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Add <c>_bin, a zero-based bin of equal width."""
    lo, hi = ranges(df, [column])[column]
    value = F.nanvl(col(column).cast("double"), F.lit(None))
    number = F.lit(None).cast("int") if lo is None else bin_of(value, lo, hi, bins)
    return df.withColumn(f"{column}_bin", number)


def bin_quantile(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Add <c>_qbin, a zero-based bin with about equally many rows; a value on an edge belongs to the lower bin."""
    cuts = column_quantiles(df, [column], [i / bins for i in range(1, bins)])[column]
    value = F.nanvl(col(column).cast("double"), F.lit(None))
    edges = sorted({e for e in cuts.values() if e is not None})
    number = sum((F.when(value > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(f"{column}_qbin", F.when(value.isNotNull(), number))


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Add <a>_per_<b> and <a>_minus_<b> for the strongly correlated pairs (or the given ones)."""
    if pairs is None:
        pairs = [(r["col_a"], r["col_b"]) for r in strong_pairs(df).collect()]
    new: list[Column] = []
    for a, b in pairs:
        x, y = col(a).cast("double"), col(b).cast("double")
        new += [F.try_divide(x, y).alias(f"{a}_per_{b}"), (x - y).alias(f"{a}_minus_{b}")]
    return df.select("*", *new)


def feature_advice(df: DataFrame) -> DataFrame:
    """(column, feature, reason): all advice in one table."""
    spark, parts = df.sparkSession, []
    numbers, text, dates = numeric_columns(df), columns_of(df, CATEGORICAL), columns_of(df, DATETIME)
    if numbers:
        logs = log_candidates(df, numbers).where("transform <> 'none'")
        parts.append(logs.select("column", F.col("transform").alias("feature"), "reason"))
        many = distinct_summary(df, numbers).where(F.col("uniques") > K.LOW_CARDINALITY)
        parts.append(many.select(
            "column", F.lit("binning").alias("feature"), F.concat(F.lit("continuous, "), "uniques", F.lit(" distinct values")).alias("reason")
        ))
    if len(numbers) > 1:
        both = strong_pairs(df, numbers)
        parts.append(both.select(
            F.col("col_a").alias("column"), F.concat(F.lit("ratio and difference with "), "col_b").alias("feature"),
            F.concat(F.lit("correlation "), F.round("r", 4).cast("string")).alias("reason"),
        ))
    if text:
        parts.append(encoding_advice(df, text).select(
            "column", F.col("encoding").alias("feature"), F.concat("uniques", F.lit(" distinct values")).alias("reason")
        ))
    if dates:
        rows = [(c, f, "date or time column") for c in dates for f in ("year", "month", "day_of_week", "hour", "is_weekend")]
        parts.append(small_frame(spark, rows, "column string, feature string, reason string"))
    if not parts:
        return small_frame(spark, [], "column string, feature string, reason string")
    return reduce(DataFrame.unionByName, parts)
