"""Shape, schema, missing cells, duplicates, cardinality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import (
    CATEGORICAL, DATETIME, NUMERIC, class_of, col, columns_of, merge_nan, numeric_columns, profiled, rows_from, small_frame,
    with_all_columns,
)
from ..plans.frequency import distinct_summary, most_frequent
from ..plans.moments import moments
from ..plans.quantiles import column_quantiles
from ..plans.shared import is_shared, on_driver, remember
from ..session import materialize


def dataset_shape(df: DataFrame) -> DataFrame:
    """(rows, columns)"""
    if is_shared(df):
        return remember(df, "shape", lambda: on_driver(_shape(df)))
    return _shape(df)


def _shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def column_types(df: DataFrame) -> DataFrame:
    """(position, column, type); reads no data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return small_frame(df.sparkSession, rows, "position int, column string, type string")


def column_info(df: DataFrame) -> DataFrame:
    """(position, column, type, n): the types with the number of non-missing values."""
    return column_types(df).join(_present(df), "column").select("position", "column", "type", "n")


def column_classes(df: DataFrame) -> DataFrame:
    """(column, class, n): numeric, categorical, datetime or other, with the number of non-missing values."""
    rows = [(f.name, class_of(f.dataType)) for f in df.schema.fields]
    return small_frame(df.sparkSession, rows, "column string, class string").join(_present(df), "column")


def _present(df: DataFrame) -> DataFrame:
    clean = merge_nan(df)
    wide = clean.agg(*[F.count(col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    return rows_from(wide, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(df.columns)], ["column", "n"])


def select_class(df: DataFrame, kind: str = NUMERIC) -> DataFrame:
    return df.select(*[col(c) for c in columns_of(df, kind)])


def preview(df: DataFrame, order_by: Sequence[str], n: int = K.PREVIEW_ROWS) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def minimal_schema(df: DataFrame, order_by: Sequence[str], n: int = K.SCHEMA_ROWS) -> DataFrame:
    """(part, item, text): shape, column types and the first rows in one table."""
    shape = rows_from(
        dataset_shape(df),
        [(F.lit("shape"), F.lit("rows"), F.col("rows").cast("string")),
         (F.lit("shape"), F.lit("columns"), F.col("columns").cast("string"))],
        ["part", "item", "text"],
    )
    types = column_types(df).select(F.lit("type").alias("part"), F.col("column").alias("item"), F.col("type").alias("text"))
    shown = profiled(df)
    first = preview(df, order_by, n).select(F.to_json(F.struct(*[col(c) for c in shown])).alias("text"))
    first = first.select(F.lit("row").alias("part"), F.lit("").alias("item"), "text")
    return shape.unionByName(types).unionByName(first)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, null_share); NaN counts as missing."""
    cols = list(cols or df.columns)
    if is_shared(df):
        return remember(df, "nulls", lambda: on_driver(_null_counts(df, df.columns))).where(F.col("column").isin(cols))
    return _null_counts(df, cols)


def _null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    clean = merge_nan(df.select(*[col(c) for c in cols]))
    wide = clean.agg(F.count("*").alias("_rows"), *[F.count_if(col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    entries = [
        (F.lit(c), F.col(f"_{i}"), F.try_divide(F.col(f"_{i}"), F.col("_rows"))) for i, c in enumerate(cols)
    ]
    return rows_from(wide, entries, ["column", "nulls", "null_share"])


def total_nulls(df: DataFrame) -> DataFrame:
    """(nulls)"""
    return null_counts(df).agg(F.sum("nulls").alias("nulls"))


def column_overview(df: DataFrame) -> DataFrame:
    """(column, type, nulls, uniques)"""
    types = column_types(df).select("column", "type")
    uniques = distinct_summary(df).select("column", "uniques")
    return types.join(null_counts(df, profiled(df)).select("column", "nulls"), "column").join(uniques, "column")


def _fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a row.  The null pattern is hashed too, because a null leaves the hash as it is
    and would let (null, x) and (x, null) meet."""
    cols = [col(c) for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(nulls, *cols).alias("_h1"), F.xxhash64(F.lit(7919), *reversed(cols), nulls).alias("_h2")]


def duplicate_row_count(df: DataFrame, exact: bool = False) -> DataFrame:
    """(duplicates): rows that repeat an earlier row, nulls equal to each other.

    By default a 128-bit fingerprint per row is shuffled instead of the row (24 bytes each, whatever the width; two of
    10^12 different rows share one with a chance near 10^-15).  ``exact=True`` groups by the columns themselves."""
    if is_shared(df) and not exact:
        return remember(df, "duplicates", lambda: on_driver(_duplicate_row_count(df, False)))
    return _duplicate_row_count(df, exact)


def _duplicate_row_count(df: DataFrame, exact: bool) -> DataFrame:
    clean = merge_nan(df)
    keys = [col(c) for c in clean.columns] if exact else _fingerprint(clean)
    groups = clean.groupBy(*keys).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


#: Bits of the filter for repeated rows: this many for each of them, but no more in all (eight megabytes).
FILTER_BITS, MOST_BITS = 16, 1 << 26


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The rows that occur more than once, with their multiplicity n.

    Fingerprints are counted first, and those that repeat set bits in a filter.  Only rows whose fingerprint is in the filter are
    shuffled and counted by their columns, so the result is exact however full the filter is."""
    clean = merge_nan(df)
    names, (h1, h2) = [col(c) for c in clean.columns], _fingerprint(clean)
    repeated = clean.select(h1, h2).groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = materialize(repeated.select("_h1"), "repeated-rows")
    found = repeated.agg(F.count("*")).first()[0]
    words = min(1 << max(6, (FILTER_BITS * found).bit_length()), MOST_BITS) // 64
    at, bit = F.shiftrightunsigned("_h1", 6).bitwiseAND(F.lit(words - 1)), F.col("_h1").bitwiseAND(F.lit(63)).cast("int")
    one = F.expr("shiftleft(1L, cast(_h1 & 63 as int))")
    bits = F.broadcast(repeated.groupBy(at.alias("_w")).agg(F.bit_or(one).alias("_bits")))
    rows = clean.select(F.struct(*names).alias("_row"), h1).join(bits, at == F.col("_w")).where(F.bit_get("_bits", bit) == 1).select("_row.*")
    return rows.groupBy(*[col(c) for c in rows.columns]).agg(F.count("*").alias("n")).where("n > 1")


def _first_and_last(df: DataFrame) -> DataFrame:
    """(column, first, last) of the date and time columns; one row each."""
    dates = columns_of(df, DATETIME)
    if not dates:
        return small_frame(df.sparkSession, [], "column string, first timestamp_ntz, last timestamp_ntz")
    spans = [(F.min(col(c).cast("timestamp_ntz")), F.max(col(c).cast("timestamp_ntz"))) for c in dates]
    wide = df.agg(*[x.alias(f"_{i}_{j}") for i, span in enumerate(spans) for j, x in enumerate(span)])
    return rows_from(wide, [(F.lit(c), F.col(f"_{i}_0"), F.col(f"_{i}_1")) for i, c in enumerate(dates)], ["column", "first", "last"])


def describe_all(df: DataFrame) -> DataFrame:
    """(column, n, uniques, top, freq, first, last, mean, sd, min, p25, p50, p75, max) for every profiled column.

    top and freq are given for categorical, date and time columns, first and last for the latter, the moments for numeric ones."""
    numbers, named = numeric_columns(df), columns_of(df, CATEGORICAL, DATETIME)
    base = distinct_summary(df).select("column", "n", "uniques")
    if named:
        base = base.join(most_frequent(df, named), "column", "left")
    else:
        base = base.withColumn("top", F.lit(None).cast("string")).withColumn("freq", F.lit(None).cast("bigint"))
    base = base.join(_first_and_last(df), "column", "left")
    if not numbers:
        empty = [F.lit(None).cast("double").alias(c) for c in ("mean", "sd", "min", "p25", "p50", "p75", "max")]
        return base.select("*", *empty)
    quart = column_quantiles(df, numbers, [0.25, 0.5, 0.75])
    rows = [(c, quart[c][0.25], quart[c][0.5], quart[c][0.75]) for c in numbers]
    quart_rows = small_frame(df.sparkSession, rows, "column string, p25 double, p50 double, p75 double")
    stats = moments(df, numbers).select("column", "mean", "sd", "min", "max").join(quart_rows, "column")
    return base.join(stats, "column", "left").select(
        "column", "n", "uniques", "top", "freq", "first", "last", "mean", "sd", "min", "p25", "p50", "p75", "max"
    )


def constant_columns(df: DataFrame, share: float = K.NEAR_CONSTANT_SHARE) -> DataFrame:
    """(column, uniques, top_share, class): constant and near-constant columns, fewest distinct values first."""
    top_share = F.try_divide(F.col("freq"), F.col("n"))
    kind = F.when(F.col("uniques") <= 1, "constant").when(top_share >= share, "near_constant")
    return (
        distinct_summary(df)
        .select("column", "uniques", top_share.alias("top_share"), kind.alias("class"))
        .where("class is not null")
        .orderBy("uniques", "column")
    )


def id_like_columns(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """(column, uniques): columns with as many distinct values as the table has rows.

    A sketch in one scan drops the columns that are clearly below; only the rest is counted exactly."""
    cols = profiled(df)
    clean = merge_nan(df.select(*[col(c) for c in cols]))
    row = clean.agg(
        F.count("*").alias("rows"),
        *[F.approx_count_distinct(col(c), rsd).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    rows = row["rows"]
    # five standard errors of room, so that no ID column is dropped by the sketch
    likely = [c for i, c in enumerate(cols) if row[f"n{i}"] == rows and row[f"a{i}"] >= rows * (1 - 5 * rsd)]
    if not likely or not rows:
        return small_frame(df.sparkSession, [], "column string, uniques bigint")
    return distinct_summary(df, likely).where(F.col("uniques") == rows).select("column", "uniques")


def _used(plan) -> set[str]:
    """The names of the source columns that an optimized plan computes from."""
    wanted = {plan.output().apply(i).exprId().id() for i in range(plan.output().size())}
    leaves, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        inner = node.subqueries()
        nodes += below + [inner.apply(i) for i in range(inner.size())]
        if below:
            found = node.references().toSeq()
            wanted |= {found.apply(i).exprId().id() for i in range(found.size())}
        else:
            leaves.append(node.output())
    return {out.apply(i).name() for out in leaves for i in range(out.size()) if out.apply(i).exprId().id() in wanted}


def lineage(df: DataFrame, result: DataFrame) -> list[str]:
    """The columns of ``df`` that ``result`` was computed from, by the expression ids of the optimized plans.

    A column counts when all source columns behind it are used.  What an operator computed on the driver or
    read back from an intermediate table has left the plan; such results name their columns in their rows (``column_coverage``)."""
    used = _used(result._jdf.queryExecution().optimizedPlan())
    behind = {c: _used(df.select(col(c))._jdf.queryExecution().optimizedPlan()) for c in df.columns} if used else {}
    return [c for c in df.columns if behind.get(c) and behind[c] <= used]


def column_coverage(df: DataFrame, results: dict[str, DataFrame], sources: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(column, analyses, n): which results cover each column of the input; n = 0 marks a gap.

    A result covers the columns that its rows name, and those it was computed from where ``sources`` says so (``lineage``)."""
    seen = [small_frame(df.sparkSession, [(c, name) for name, cols in (sources or {}).items() for c in cols], "column string, analysis string")]
    for name, result in results.items():
        for field in ("column", "col_a", "col_b"):
            if field in result.columns:
                seen.append(result.select(F.col(field).alias("column"), F.lit(name).alias("analysis")))
    found = reduce(DataFrame.unionByName, seen).distinct()
    listed = found.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_set("analysis")), ",").alias("analyses"), F.count("*").alias("n")
    )
    return with_all_columns(listed, df.columns).select(
        "column", F.coalesce("analyses", F.lit("")).alias("analyses"), F.coalesce("n", F.lit(0)).alias("n")
    )
