"""Normality and group-comparison tests; statistics are Spark aggregates, p-values are computed on the result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import col, doubles, numeric_columns, small_frame
from ..functions.normality import with_normality
from ..functions.pvalues import chi2_pvalue, z_pvalue
from ..plans.moments import moments
from ..plans.ordered import split_points
from ..plans.ranks import ranked_values
from ..session import materialize
from .overview import null_counts
from .relations import corr_pairs, group_columns, ranks_of, spearman_matrix, with_significance


def normality_test(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, z_skew, z_kurt, k2, p, normal)"""
    tested = with_normality(moments(df, cols).select("column", "n", "g1", "g2"))
    return tested.select("column", "n", "z_skew", "z_kurt", "k2", F.exp(-F.col("k2") / 2).alias("p")).withColumn(
        "normal", F.col("p") > K.NORMAL_P)


def _ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    rows = doubles(df, [value], [group]).where(col(group).isNotNull())
    return ranked_values(rows, value, split_points(rows, [value])[value], group)


def _tie_term() -> Column:
    """Summed over the groups of a value this is ties^3 - ties; in double, because the cube leaves the bigint range."""
    return F.col("n").cast("double") * (F.col("ties").cast("double") * F.col("ties") - 1.0)


def mann_whitney(df: DataFrame, group: str, value: str, first=None, second=None) -> DataFrame:
    """(n1, n2, u1, z, p): two-sided, asymptotic with tie and continuity correction.

    The groups are given, or the column must have exactly two values (taken in order)."""
    if first is None or second is None:
        names = df.where(col(group).isNotNull()).select(col(group)).distinct().limit(3).collect()
        if len(names) != 2:
            raise ValueError(f"{group} does not have two groups; name them or use kruskal_wallis")
        first, second = sorted(r[0] for r in names)
    both = df.where(col(group).isin(first, second))
    one = F.col("_group") == F.lit(first)
    n = F.col("n").cast("double")
    sums = _ranked(both, group, value).agg(
        F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(~one, F.col("n"))), F.lit(0)).alias("n2"),
        F.sum(F.when(one, n * F.col("rank"))).alias("r1"), F.sum(_tie_term()).alias("t"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("t"), total * (total - 1)))
    z = F.try_divide(F.greatest("u1", n1 * n2 - F.col("u1")) - n1 * n2 / 2 - 0.5, F.sqrt(var))
    return sums.withColumn("u1", u1).withColumn("z", z).select(
        "n1", "n2", "u1", "z", F.least(F.lit(1.0), z_pvalue(F.greatest(F.col("z"), F.lit(0.0)))).alias("p")
    )


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, h, df, p): tie-corrected rank test over any number of groups."""
    n = F.col("n").cast("double")
    per_group = _ranked(df, group, value).groupBy("_group").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("rank")).alias("r"), F.sum(_tie_term()).alias("t")
    )
    # mean ranks less their expectation: the difference of two large sums would lose the statistic of large tables
    expected = (per_group.agg(F.sum("n").cast("double")).scalar() + 1) / 2
    sums = per_group.withColumn("off", F.col("r") / F.col("n") - expected).agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.col("n") * F.col("off") * F.col("off")).alias("q"), F.sum("t").alias("t"),
    )
    total = F.col("n").cast("double")
    raw = F.try_divide(F.lit(12.0), total * (total + 1)) * F.col("q")
    h = F.try_divide(raw, 1 - F.try_divide(F.col("t"), total * total * total - total))
    return sums.select("groups", "n", F.when(F.col("groups") > 1, h).alias("h"), (F.col("groups") - 1).alias("df")).withColumn(
        "p", chi2_pvalue(F.col("h"), F.col("df").cast("double"))
    )


def all_group_tests(df: DataFrame, groups: Sequence[str] | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """(category, column, groups, n, h, df, p): the rank test of every numeric column over the groups of every category column.

    ``groups`` are by default the categorical columns with few values.  All columns are ranked in one shuffle; the statistic is the
    share of the ranks' variance that lies between the groups, which needs no count of ties.  A column of one value has no h."""
    groups, cols = list(groups if groups is not None else group_columns(df)), numeric_columns(df, cols)
    if not groups or not cols:
        return small_frame(df.sparkSession, [], "category string, column string, groups bigint, n bigint, h double, df bigint, p double")
    holes = {r["column"] for r in null_counts(df, groups).where("nulls > 0").collect()}
    views = sorted({(c, g if g in holes else "") for c in cols for g in groups})
    ranked = ranks_of(df, views, keep=groups)
    cells = [(F.lit(j), F.col(f"k{j}"), F.lit(i), F.col(f"r{views.index((c, g if g in holes else ''))}")) for j, g in enumerate(groups) for i, c in enumerate(cols)]
    long = ranked.select(F.stack(F.lit(len(cells)), *[x for cell in cells for x in cell]).alias("category", "value", "column", "rank"))
    pair, n = ["category", "column"], F.col("n").cast("double")
    per_group = long.dropna().groupBy(*pair, "value").agg(F.count("*").alias("n"), F.avg("rank").alias("mean"), F.var_pop("rank").alias("var"))
    per_group = materialize(per_group, "group-ranks")  # read twice
    whole = per_group.groupBy(*pair).agg(F.count("*").alias("groups"), F.sum("n").alias("total"))
    off = F.col("mean") - (F.col("total") + 1) / 2
    sums = per_group.join(F.broadcast(whole), pair).groupBy(*pair, "groups", "total").agg(
        F.sum(n * off * off).alias("between"), F.sum(n * F.col("var")).alias("within"))
    h = F.when(F.col("groups") > 1, F.try_divide((F.col("total") - 1) * F.col("between"), F.col("between") + F.col("within")))
    named = [F.get(F.array(*map(F.lit, names)), F.col(c)).alias(c) for c, names in zip(pair, (groups, cols))]
    return sums.select(*named, "groups", F.col("total").alias("n"), h.alias("h"), (F.col("groups") - 1).alias("df")).withColumn(
        "p", chi2_pvalue(F.col("h"), F.col("df").cast("double")))


def group_comparison(df: DataFrame, group: str, value: str) -> DataFrame:
    """(test, groups, n, statistic, p): rank test of two groups, or of three and more."""
    valid = col(value).isNotNull() & ~F.isnan(col(value).cast("double"))  # NaN is a missing value
    found = df.where(col(group).isNotNull() & valid).select(col(group)).distinct().limit(3).count()
    if found == 2:
        n = F.col("n1") + F.col("n2")
        return mann_whitney(df.where(valid), group, value).select(
            F.lit("mann_whitney").alias("test"), F.lit(2).cast("bigint").alias("groups"), n.alias("n"), F.col("u1").alias("statistic"), "p"
        )
    return kruskal_wallis(df, group, value).select(
        F.lit("kruskal_wallis").alias("test"), "groups", "n", F.col("h").alias("statistic"), "p"
    )


def correlation_choice(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, method, n, r, t, p): Pearson where both columns pass the normality test, otherwise Spearman."""
    cols = numeric_columns(df, cols)
    normal = {r["column"] for r in normality_test(df, cols).where("normal").collect()}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    by_rank = [p for p in pairs if not (p[0] in normal and p[1] in normal)]
    parts = []
    if len(by_rank) < len(pairs):
        named = [c for c in cols if c in normal]
        parts.append(corr_pairs(df, named).withColumn("method", F.lit("pearson")))
    if by_rank or not parts:
        parts.append(spearman_matrix(df, cols, by_rank).withColumn("method", F.lit("spearman")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return with_significance(found).select("col_a", "col_b", "method", "n", "r", "t", "p")
