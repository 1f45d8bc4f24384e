"""Correlations and group-by views of column pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import CATEGORICAL, col, columns_of, doubles, numeric_columns, small_frame
from ..functions.pvalues import t_pvalue
from ..plans.comoments import correlation
from ..plans.frequency import distinct_summary
from ..plans.quantiles import group_quantiles
from ..plans.ranks import rank_columns
from ..plans.sampling import lowest_by_hash
from ..plans.shared import is_shared, remember
from ..session import materialize
from .numeric import bin_of, ranges
from .overview import null_counts


def _named(pairs: DataFrame, cols: Sequence[str], mirror: bool = True) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    a, b = F.get(names, F.col("i")), F.get(names, F.col("j"))
    if not mirror:
        return pairs.where("i < j").select(a.alias("col_a"), b.alias("col_b"), "n", "r")
    one = F.struct(a.alias("col_a"), b.alias("col_b"), "n", "r")
    two = F.struct(b.alias("col_a"), a.alias("col_b"), "n", "r")
    return pairs.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(one)).otherwise(F.array(one, two))))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, n, r): Pearson over pairwise-complete rows, the full matrix in long form."""
    cols = numeric_columns(df, cols)
    return _named(correlation(df, cols), cols)


def corr_wide(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The matrix as a table: one row and one value column per numeric column."""
    cols = numeric_columns(df, cols)
    return corr_matrix(df, cols).groupBy("col_a").pivot("col_b", cols).agg(F.first("r")).withColumnRenamed("col_a", "column")


def corr_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, n, r), each pair once in column order."""
    cols = numeric_columns(df, cols)
    return _named(correlation(df, cols), cols, mirror=False)


def strong_pairs(df: DataFrame, cols: Sequence[str] | None = None, cut: float = K.STRONG_CORRELATION) -> DataFrame:
    """The pairs with |r| above the cut, strongest first."""
    return corr_pairs(df, cols).where(F.abs("r") > cut).orderBy(F.desc(F.abs("r")), "col_a", "col_b")


def _all_ranks(df: DataFrame) -> tuple[list[tuple[str, str]], list[str], DataFrame]:
    """The views, the category columns and the ranks that correlations and group tests of the whole table need."""
    numbers, groups = numeric_columns(df), group_columns(df)
    holes = [r["column"] for r in null_counts(df, numbers + groups).where("nulls > 0").collect()]
    views = sorted({(a, b) for a in numbers for b in ("", *holes) if a != b})
    return views, groups, materialize(rank_columns(df, [(a, b or None) for a, b in views], keep=groups), "ranks")


def ranks_of(df: DataFrame, views: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """As ``rank_columns``, with '' for no second column; inside ``shared_results`` one ranking, written once, serves all analyses."""
    if is_shared(df):
        known, groups, ranked = remember(df, "ranks", lambda: _all_ranks(df))
        if set(views) <= set(known) and set(keep) <= set(groups):
            return ranked.select(
                *[F.col(f"r{known.index(v)}").alias(f"r{i}") for i, v in enumerate(views)],
                *[F.col(f"k{groups.index(c)}").alias(f"k{i}") for i, c in enumerate(keep)])
    return rank_columns(df, [(a, b or None) for a, b in views], keep)


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(col_a, col_b, n, r), each pair once: rank correlation over pairwise-complete rows.

    A column is ranked once, and once more for every partner that has missing values (only the partner's complete rows
    count then).  All of them are ranked together, so the number of shuffles does not depend on the number of columns."""
    cols = numeric_columns(df, cols)
    pairs = list(pairs) if pairs is not None else [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return small_frame(df.sparkSession, [], "col_a string, col_b string, n bigint, r double")
    cols = [c for c in cols if any(c in p for p in pairs)]
    holes = {r["column"] for r in null_counts(df, cols).where("nulls > 0").collect()}
    views = sorted({(a, b if b in holes else "") for p in pairs for a, b in (p, p[::-1])})
    names = [f"r{i}" for i in range(len(views))]
    result = correlation(ranks_of(df, views), names)
    at = {v: i for i, v in enumerate(views)}
    wanted = []
    for a, b in pairs:
        i, j = at[(a, b if b in holes else "")], at[(b, a if a in holes else "")]
        wanted.append((min(i, j), max(i, j), a, b))
    lookup = small_frame(df.sparkSession, wanted, "i int, j int, col_a string, col_b string")
    return result.join(F.broadcast(lookup), ["i", "j"]).select("col_a", "col_b", "n", "r")


def with_significance(pairs: DataFrame) -> DataFrame:
    """Add t and the two-sided p to (…, n, r)."""
    n, r = F.col("n").cast("double"), F.col("r")
    t = F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))
    exact = F.when((n > 2) & (F.abs(r) >= 1), F.lit(0.0))
    return pairs.withColumn("t", t).withColumn("p", F.coalesce(exact, t_pvalue(F.col("t"), n - 2)))


def corr_significance(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, n, r, t, p)"""
    return with_significance(corr_pairs(df, cols))


def _moments_of(v: Column) -> dict[str, Column]:
    return {"n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}


def _group_stats(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """(group, n, mean, sd, min, max, q0, q1, …); a category without a value has n = 0."""
    rows = doubles(df, [value], [group]).select(col(group).alias("group"), col(value).alias("value")).where("group is not null")
    found = group_quantiles(rows, ["group"], "value", probs, stats=_moments_of(F.col("value")))
    bare = rows.select("group").distinct().join(found.select("group"), "group", "left_anti")
    return found.unionByName(bare.withColumn("n", F.lit(0).cast("bigint")), allowMissingColumns=True)


def group_describe(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, sd, min, p25, median, p75, max) of a numeric column per category."""
    return _group_stats(df, group, value, (0.25, 0.5, 0.75)).select(
        "group", "n", "mean", "sd", "min", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), "max"
    )


def group_agg(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, sd, median)"""
    return _group_stats(df, group, value, (0.5,)).select("group", "n", "mean", "sd", F.col("q0").alias("median"))


def group_columns(df: DataFrame, most: int = K.LOW_CARDINALITY) -> list[str]:
    """The categorical columns with two to ``most`` values."""
    found = distinct_summary(df, columns_of(df, CATEGORICAL)).where(F.col("uniques").between(2, most)).select("column").collect()
    names = {r["column"] for r in found}
    return [c for c in df.columns if c in names]


def _by_category(rows: DataFrame, groups: dict[str, str], values: dict[str, str]) -> DataFrame:
    """(category, value, column, x): one row for each cell of a category column and a number column, from {name: column of ``rows``}."""
    cats = F.stack(F.lit(len(groups)), *[x for name, c in groups.items() for x in (F.lit(name), col(c).cast("string"))]).alias("category", "value")
    long = rows.select(cats, *[col(c).alias(f"_x{i}") for i, c in enumerate(values.values())]).where("value is not null")
    cells = F.stack(F.lit(len(values)), *[x for i, name in enumerate(values) for x in (F.lit(name), F.col(f"_x{i}"))]).alias("column", "x")
    return long.select("category", "value", cells).where("x is not null")


def all_group_stats(df: DataFrame, groups: Sequence[str] | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """(category, value, column, n, mean, sd, min, p25, median, p75, max) of every numeric column in every category.

    ``groups`` are by default the categorical columns with few values.  All pairs share the passes of one grouped quantile: one for moments
    and brackets, one for counts between the brackets."""
    groups, cols = list(groups if groups is not None else group_columns(df)), numeric_columns(df, cols)
    if not groups or not cols:
        kinds = "category string, value string, column string, n bigint, mean double, sd double, min double, p25 double, median double, p75 double, max double"
        return small_frame(df.sparkSession, [], kinds)
    long = _by_category(doubles(df, cols, groups), {g: g for g in groups}, {c: c for c in cols})
    found = group_quantiles(long, ["category", "value", "column"], "x", (0.25, 0.5, 0.75), stats=_moments_of(F.col("x")))
    return found.select(
        "category", "value", "column", "n", "mean", "sd", "min", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), "max")


def scatter_grid(df: DataFrame, cut: float = K.STRONG_CORRELATION, bins: int = 20) -> DataFrame:
    """(col_a, col_b, bin_a, bin_b, n): the points of every strongly correlated pair as a grid of counts, all pairs in one scan."""
    pairs = [(r["col_a"], r["col_b"]) for r in strong_pairs(df, cut=cut).collect()]
    if not pairs:
        return small_frame(df.sparkSession, [], "col_a string, col_b string, bin_a int, bin_b int, n bigint")
    cols = [c for c in numeric_columns(df) if any(c in p for p in pairs)]
    span = ranges(df, cols)
    place = {c: F.when(col(c).isNotNull(), bin_of(col(c), *span[c], bins)) for c in cols}
    points = F.stack(F.lit(len(pairs)), *[x for a, b in pairs for x in (F.lit(a), F.lit(b), place[a], place[b])]).alias("col_a", "col_b", "bin_a", "bin_b")
    return doubles(df, cols).select(points).dropna().groupBy("col_a", "col_b", "bin_a", "bin_b").agg(F.count("*").alias("n"))


def cross_group(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """(first, second, n, total, mean) for two category columns."""
    rows = doubles(df, [value], [first, second]).where(col(first).isNotNull() & col(second).isNotNull())
    return rows.groupBy(col(first), col(second)).agg(
        F.count(col(value)).alias("n"), F.sum(col(value)).alias("total"), F.avg(col(value)).alias("mean")
    )


def scatter_sample(df: DataFrame, a: str, b: str, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """(key, a, b): n points, the same ones however the data is partitioned."""
    rows = doubles(df, [a, b], [key]).where(col(a).isNotNull() & col(b).isNotNull())
    return lowest_by_hash(rows, [key], n, seed)


def scatter_bins(df: DataFrame, a: str, b: str, bins: int = 20) -> DataFrame:
    """(bin_a, bin_b, n): all points of a pair as a grid of counts."""
    span = ranges(df, [a, b])
    if span[a][0] is None or span[b][0] is None:
        return small_frame(df.sparkSession, [], "bin_a int, bin_b int, n bigint")
    rows = doubles(df, [a, b]).where(col(a).isNotNull() & col(b).isNotNull())
    return rows.groupBy(bin_of(col(a), *span[a], bins).alias("bin_a"), bin_of(col(b), *span[b], bins).alias("bin_b")).agg(
        F.count("*").alias("n")
    )
