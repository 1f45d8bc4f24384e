"""Outliers by fences and z-scores, and rule violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import col, doubles, merge_nan, numeric_columns, rows_from, small_frame
from ..plans.moments import moments
from ..plans.quantiles import column_quantiles
from ..plans.shared import is_shared, on_driver, remember
from .numeric import fences


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    q = column_quantiles(df, cols, (0.25, 0.75))
    return {c: fences(q[c][0.25], q[c][0.75]) for c in cols if q[c][0.25] is not None}


def iqr_outlier_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, lo, hi, n_iqr)"""
    cols, known = numeric_columns(df, cols), numeric_columns(df)
    if is_shared(df) and set(cols) <= set(known):
        return remember(df, "fences", lambda: on_driver(_iqr_outlier_counts(df, known))).where(F.col("column").isin(cols))
    return _iqr_outlier_counts(df, cols)


def _iqr_outlier_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bounds = iqr_bounds(df, cols)
    if not bounds:
        return small_frame(df.sparkSession, [], "column string, lo double, hi double, n_iqr bigint")
    wide = doubles(df, list(bounds)).agg(
        *[F.count_if((col(c) < lo) | (col(c) > hi)).alias(f"_{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())]
    )
    entries = [(F.lit(c), F.lit(lo), F.lit(hi), F.col(f"_{i}")) for i, (c, (lo, hi)) in enumerate(bounds.items())]
    return rows_from(wide, entries, ["column", "lo", "hi", "n_iqr"])


def iqr_outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows outside the fences of one column."""
    bounds = iqr_bounds(df, [column])
    if not bounds:
        return df.where("false")
    lo, hi = bounds[column]
    v = col(column).cast("double")
    return df.where(((v < lo) | (v > hi)) & ~F.isnan(v))


def _centres(df: DataFrame, cols: Sequence[str], sd: str) -> dict[str, tuple[float, float]]:
    """{column: (mean, sd)} of the columns with spread; two numbers per column reach the driver."""
    rows = moments(df, cols).select("column", "mean", sd).collect()
    return {r["column"]: (r["mean"], r[sd]) for r in rows if r[sd]}


def zscore_outlier_counts(df: DataFrame, cols: Sequence[str] | None = None, cut: float = K.Z_CUT) -> DataFrame:
    """(column, n_z): |z| above the cut with the sample standard deviation, column by column."""
    cols = numeric_columns(df, cols)
    centres = _centres(df, cols, "sd")
    parts, entries = [], []
    for i, c in enumerate(cols):
        mean, sd = centres.get(c, (0.0, None))
        far = F.abs((col(c) - F.lit(mean)) / F.lit(sd)) > cut if sd else F.lit(False)
        parts.append(F.count_if(far).alias(f"_{i}"))
        entries.append((F.lit(c), F.col(f"_{i}")))
    return rows_from(doubles(df, cols).agg(*parts), entries, ["column", "n_z"])


def zscore_row_flags(df: DataFrame, cols: Sequence[str] | None = None, cut: float = K.Z_CUT) -> DataFrame:
    """The complete rows with max_z, the largest |z| (population standard deviation), above the cut."""
    cols = numeric_columns(df, cols)
    rows = merge_nan(df).dropna(subset=cols)
    whole = is_shared(df) and set(cols) <= set(numeric_columns(df)) and moments(df, cols).where("nulls > 0").isEmpty()
    centres = _centres(df if whole else rows, cols, "sd_pop")
    scores: list[Column] = [F.abs((col(c).cast("double") - F.lit(m)) / F.lit(s)) for c, (m, s) in centres.items()]
    if not scores:
        return rows.withColumn("max_z", F.lit(0.0)).where("false")
    worst = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return rows.withColumn("max_z", worst).where(F.col("max_z") > cut)


def mostly_positive_rules(df: DataFrame, share: float = 0.05, cols: Sequence[str] | None = None) -> dict[str, str]:
    """A rule per numeric column whose values are negative in at most the given share of the rows, but in some."""
    found = moments(df, cols).where((F.col("negatives") > 0) & (F.col("negatives") <= share * F.col("n"))).collect()
    return {f"negative_{r['column']}": "`" + r["column"].replace("`", "``") + "` < 0" for r in found}


def rule_violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(rule, n): rows for which the SQL predicate of the rule holds; all rules in one scan."""
    names = list(rules)
    if not names:
        return small_frame(df.sparkSession, [], "rule string, n bigint")
    wide = df.agg(*[F.count_if(F.expr(rules[r])).alias(f"_{i}") for i, r in enumerate(names)])
    return rows_from(wide, [(F.lit(r), F.col(f"_{i}")) for i, r in enumerate(names)], ["rule", "n"])


def violating_rows(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """The rows that break a rule, with the names of the rules."""
    broken = F.filter(F.array(*[F.when(F.expr(p), F.lit(r)) for r, p in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rules", broken).where(F.size("rules") > 0)


def outlier_ranking(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, lo, hi, n_iqr, n_z), most outliers first."""
    cols = numeric_columns(df, cols)
    return (
        iqr_outlier_counts(df, cols).join(zscore_outlier_counts(df, cols), "column")
        .orderBy(F.desc("n_iqr"), F.desc("n_z"), "column")
    )
