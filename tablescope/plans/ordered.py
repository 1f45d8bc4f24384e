"""Ordered computations (ranks, running sums, previous values) without a global sort in one task.

Rows are cut into buckets along the order by split points taken from an approximate quantile sketch.  Buckets are sorted
independently; a table with one total per bucket carries sums and the last value across bucket borders.  Split
points only balance the work: the result is exact for any choice of them.  A value that equals a split point gets a bucket
of its own, and where a tie column is given such a bucket is cut again along the tie column, so a value that fills a
third of the table is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col
from ..session import parallelism
from .sketch import K_CUTS, sketch


def split_points(df: DataFrame, cols: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Strictly increasing split points per column; one narrow scan, at most ``parts`` numbers per column reach the driver."""
    parts = parts or parallelism(df.sparkSession)
    probs = [i / parts for i in range(1, parts)]
    row = sketch(df.select(*[col(c).cast("double").alias(c) for c in cols]), {c: probs for c in cols}, max(K_CUTS, min(8 * parts, 65_535)))
    return {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(cols)}


def with_buckets(df: DataFrame, splits: dict[str, list[float]], isolate: bool = False) -> DataFrame:
    """Add an increasing bucket number ``_b_<column>`` for each column of ``splits`` (columns must be numeric)."""
    cut = {c: [p for p in points if p == p] for c, points in splits.items()}
    cols = [c for c in cut if cut[c]]
    if cols:
        df = df.select("*", *[col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
        inf = float("inf")
        df = Bucketizer(
            splitsArray=[[-inf, *cut[c], inf] for c in cols],
            inputCols=[f"_x{i}" for i in range(len(cols))],
            outputCols=[f"_r{i}" for i in range(len(cols))],
            handleInvalid="keep",
        ).transform(df)
    out = []
    for c in cut:
        if c not in cols:
            out.append(F.lit(0).alias(f"_b_{c}"))
            continue
        i = cols.index(c)
        number = F.col(f"_r{i}").cast("int")
        if isolate:
            low = F.get(F.array(F.lit(float("-inf")), *map(F.lit, cut[c])), number)
            number = 2 * number + F.when(F.col(f"_x{i}") == low, 0).otherwise(1)
        # never null, so that no join infers a filter that would evaluate the bucket again
        out.append(F.coalesce(number, F.lit(0)).alias(f"_b_{c}"))
    return df.select("*", *out).drop(*[f"_x{i}" for i in range(len(cols))], *[f"_r{i}" for i in range(len(cols))])


def cut_along(df: DataFrame, order: str, tie: str | None = None, parts: int | None = None) -> tuple[DataFrame, list[str]]:
    """Bucket columns along (order, tie); returns the frame and the bucket column names."""
    splits = split_points(df, [order] + ([tie] if tie else []), parts)
    if tie is None:
        return with_buckets(df, splits), [f"_b_{order}"]
    df = with_buckets(with_buckets(df, {order: splits[order]}, isolate=True), {tie: splits[tie]})
    single = F.col(f"_b_{order}") % 2 == 0
    sub = F.when(single, F.col(f"_b_{tie}")).otherwise(0) if splits[order] else F.lit(0)
    return df.withColumn("_s", sub).drop(f"_b_{tie}"), [f"_b_{order}", "_s"]


def scan(
    df: DataFrame,
    buckets: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    keys: Sequence[str] = (),
    few_keys: bool = True,
    peers: bool = False,
    previous: str | None = None,
    raw: DataFrame | None = None,
) -> DataFrame:
    """Running sums along the order, per key.

    ``sums`` maps result names to columns.  ``peers`` includes all rows that tie in ``order``.  ``previous`` names a result
    column with the preceding value of ``order[0]``.  ``few_keys`` states that the number of keys is bounded by the schema, so
    that the table of bucket totals (keys x buckets rows) may be broadcast; otherwise the join strategy is left to the optimizer.

    ``raw`` is the input before it was aggregated to ``df``, with the same bucket columns.  The totals then come from a narrow scan of it
    with a tiny shuffle.  Without it they come from ``df``, which is right when they need the same columns as the rows, because
    the shuffle below is then planned once and reused."""
    keys, buckets = list(keys), list(buckets)
    by = keys + buckets
    # the join drops missing keys anyway; said here, it is the same filter in both branches and their shuffle stays reusable
    for k in by:
        df = df.where(col(k).isNotNull())
    totals = (raw if raw is not None else df).groupBy(*by).agg(
        *[F.sum(col(c)).alias(f"_t_{name}") for name, c in sums.items()], F.max(col(order[0])).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
        F.max("_last").over(before).alias("_carry"),
    )
    inside = Window.partitionBy(*by).orderBy(*order)
    running = inside if peers else inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(F.broadcast(carried) if few_keys else carried, by)
    out: list[Column] = [col(c) for c in df.columns]
    out += [(F.col(f"_o_{name}") + F.sum(col(c)).over(running)).alias(name) for name, c in sums.items()]
    if previous:
        out.append(F.coalesce(F.lag(col(order[0])).over(inside), F.col("_carry")).alias(previous))
    return joined.select(*out)
