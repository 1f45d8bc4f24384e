"""Calendar counts, gaps, rolling means, trends and autocorrelation."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import TimestampType

from .. import constants as K
from ..functions.columns import DATETIME, clock, col, columns_of, doubles, long_doubles, numeric_columns, rows_from, seconds
from ..plans.fourier import lag_sums
from ..plans.ordered import cut_along, scan, split_points, with_buckets
from ..plans.quantiles import weighted_quantiles
from ..session import materialize

MICROS = 1_000_000
DAY = 86_400 * MICROS
GRAINS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}


def truncated(ts: str, grain: str) -> Column:
    """The start of the period a time lies in, by the clock's reading."""
    at = col(ts).cast("timestamp_ntz")
    day = at.cast("date")
    if grain == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(at))
    return (day if grain == "day" else F.trunc(day, grain)).cast("timestamp_ntz")


def date_range(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, nulls)"""
    cols = list(cols or columns_of(df, DATETIME))
    at = {c: col(c).cast("timestamp_ntz") for c in cols}
    wide = df.agg(
        *[x for i, c in enumerate(cols) for x in (
            F.min(at[c]).alias(f"a{i}"), F.max(at[c]).alias(f"b{i}"), F.count_if(col(c).isNull()).alias(f"n{i}"))]
    )
    entries = [(F.lit(c), F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"n{i}")) for i, c in enumerate(cols)]
    return rows_from(wide, entries, ["column", "min", "max", "nulls"])


def _counted(df: DataFrame, period: Column) -> DataFrame:
    return df.select(period.alias("period")).where("period is not null").groupBy("period").agg(F.count("*").alias("n")).orderBy("period")


def counts_by_year(df: DataFrame, ts: str) -> DataFrame:
    """(period, n) with the year as a number"""
    return _counted(df, F.year(col(ts)).cast("bigint"))


def counts_by_month(df: DataFrame, ts: str) -> DataFrame:
    return _counted(df, truncated(ts, "month"))


def counts_by_week(df: DataFrame, ts: str) -> DataFrame:
    """Weeks start on Monday."""
    return _counted(df, truncated(ts, "week"))


def counts_by_weekday(df: DataFrame, ts: str) -> DataFrame:
    """0 = Monday"""
    return _counted(df, F.weekday(col(ts)).cast("bigint"))


def counts_by_month_of_year(df: DataFrame, ts: str) -> DataFrame:
    return _counted(df, F.month(col(ts)).cast("bigint"))


def _gaps(df: DataFrame, ts: str) -> DataFrame:
    """(t, prev, gap, copies) per distinct time in microseconds.

    Rows at the same time are counted before the shuffle: they are gaps of zero, however many there are."""
    rows = df.select(seconds(ts).alias("t")).where("t is not null")
    cut = with_buckets(rows, split_points(rows, ["t"]))
    times = cut.groupBy("_b_t", "t").agg(F.count("*").alias("copies"))
    ordered = scan(times, ["_b_t"], ["t"], {}, previous="prev", raw=cut)
    return materialize(ordered.select("t", "prev", (F.col("t") - F.col("prev")).alias("gap"), "copies"), "gaps")


def _gap_quantiles(gaps: DataFrame, probs: Sequence[float]) -> dict[float, float | None]:
    pairs = F.inline(F.array(
        F.struct(F.col("gap").alias("g"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("g"), (F.col("copies") - 1).alias("n")),
    ))
    counts = gaps.select(pairs).where("g is not null and n > 0").groupBy("g").agg(F.sum("n").alias("n"))
    return weighted_quantiles(counts, "g", "n", probs)


def gap_stats(df: DataFrame, ts: str) -> DataFrame:
    """(n, mean, sd, min, p25, p50, p75, max, even): seconds between consecutive records in time order."""
    gaps = _gaps(df, ts)
    q = _gap_quantiles(gaps, (0.25, 0.5, 0.75))
    sec = F.col("gap") / F.lit(float(MICROS))
    row = gaps.agg(
        F.count(sec).cast("double").alias("d"), F.sum(F.col("copies") - 1).cast("double").alias("z"),
        F.avg(sec).alias("m"), F.var_pop(sec).alias("v"), F.min(sec).alias("lo"), F.max(sec).alias("hi"),
    )
    d, z, m, v = (F.col(c) for c in "dzmv")
    n = d + z
    # distinct-time gaps and the zero gaps of repeated times are two groups; pool their squared deviations
    pooled = F.coalesce(d * v + m * m * F.try_divide(d * z, n), F.lit(0.0))
    lowest = F.when(z > 0, F.lit(0.0)).otherwise(F.col("lo"))
    highest = F.coalesce("hi", F.when(z > 0, F.lit(0.0)))
    cuts = [F.lit(None if q[p] is None else q[p] / MICROS).cast("double").alias(a) for p, a in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return row.select(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
        F.when(n > 0, F.coalesce(d * m, F.lit(0.0)) / n).alias("mean"),
        F.when(n > 1, F.sqrt(pooled / (n - 1))).alias("sd"),
        lowest.alias("min"), *cuts, highest.alias("max"), (lowest == highest).alias("even"),
    )


def gap_list(df: DataFrame, ts: str, factor: float = K.GAP_FACTOR) -> DataFrame:
    """(start, end, seconds) of the gaps longer than ``factor`` times the median gap."""
    gaps = _gaps(df, ts)
    median = _gap_quantiles(gaps, (0.5,))[0.5]
    long = gaps.where(F.col("gap") > F.lit(factor * median)) if median is not None else gaps.where("false")
    instant = isinstance(df.schema[ts].dataType, TimestampType)
    shown = lambda c: F.timestamp_micros(c).cast("timestamp_ntz") if instant else clock(c)
    return long.select(
        shown(F.col("prev")).alias("start"), shown(F.col("t")).alias("end"),
        (F.col("gap") / F.lit(float(MICROS))).alias("seconds"),
    )


def rolling_mean(
    df: DataFrame, ts: str, value: str, keep: Sequence[str] = (), by: Sequence[str] = (), days: float = K.ROLLING_DAYS
) -> DataFrame:
    """(keep…, by…, ts, value, rolling_mean): trailing mean over (t - days, t], nulls skipped, ties included.

    Time is cut into slices of one window length.  A window is the start of its own slice, summed forwards, and the end of the slice
    before, summed backwards.  Nothing is ever subtracted, so a huge or infinite value leaves no trace once it is out of the window.
    Both sums are built per bucket of time, so neither a hot key nor a crowded month is confined to one task."""
    span = int(days * DAY)
    by, keep = list(by), [k for k in keep if k not in by]
    rows = doubles(df, [value], [*by, *keep, ts]).withColumn("_t", seconds(ts)).where("_t is not null")
    for k in by:
        rows = rows.where(col(k).isNotNull())
    v, c = F.coalesce(col(value), F.lit(0.0)), col(value).isNotNull().cast("bigint")
    t = F.col("_t")
    start = t - F.pmod(t, F.lit(span))

    zero, none = F.lit(0.0), F.lit(0).cast("bigint")

    def part(slot: Column, at: Column, *values: Column) -> Column:
        names = ("_s", "_c", "_p", "_q", "_own")
        return F.struct(slot.alias("_slot"), at.alias("_t"), *[x.alias(n) for x, n in zip(values, names)])

    # in the next slice a value belongs to the windows that end before it is a window length old
    parts = rows.select(*[col(k) for k in by], F.inline(F.array(
        part(start, t, v, c, zero, none, none + 1), part(start + span, t + (span - 1), zero, none, v, c, none),
    )))
    points = split_points(rows, ["_t"])["_t"]
    cut = with_buckets(parts, {"_t": points})
    net = cut.groupBy(*[col(k) for k in by], "_slot", "_b__t", "_t").agg(*[F.sum(n).alias(n) for n in ("_s", "_c", "_p", "_q", "_own")])

    def backwards(df: DataFrame) -> DataFrame:
        return with_buckets(df.withColumn("_back", -F.col("_t")), {"_back": sorted(-p for p in points)})

    slots = [*by, "_slot"]
    ahead = scan(net, ["_b__t"], ["_t"], {"_sum": "_s", "_cnt": "_c"}, keys=slots, few_keys=False, raw=cut)
    both = scan(backwards(ahead), ["_b__back"], ["_back"], {"_sum2": "_p", "_cnt2": "_q"}, keys=slots, few_keys=False, raw=backwards(parts))
    n = F.col("_cnt") + F.col("_cnt2")
    means = both.where("_own > 0").select(
        *[col(k) for k in by], "_t", F.when(n > 0, (F.col("_sum") + F.col("_sum2")) / n).alias("rolling_mean")
    )
    return rows.join(means, [*by, "_t"]).select(*[col(k) for k in (*keep, *by)], col(ts), col(value), "rolling_mean")


def monthly_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(period, n, mean)"""
    return trend_line(df, ts, value, "month").select("period", "n", "mean")


def pick_grain(df: DataFrame, ts: str) -> str:
    row = df.agg(F.min(seconds(ts)).alias("a"), F.max(seconds(ts)).alias("b")).first()
    days = ((row["b"] or 0) - (row["a"] or 0)) / DAY
    return "hour" if days <= 2 else "day" if days <= 92 else "month" if days <= 366 * 10 else "year"


def trend_line(df: DataFrame, ts: str, value: str, grain: str | None = None) -> DataFrame:
    """(period, n, total, mean) of a value per period; the grain follows from the time range unless given."""
    grain = grain or pick_grain(df, ts)
    rows = doubles(df, [value], [ts]).select(truncated(ts, grain).alias("period"), col(value).alias("v"))
    return rows.where("period is not null").groupBy("period").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean")
    ).orderBy("period")


def trend_lines(df: DataFrame, ts: str, cols: Sequence[str] | None = None, grain: str | None = None) -> DataFrame:
    """(column, period, n, total, mean) of every numeric column per period, in one scan."""
    cols, grain = numeric_columns(df, cols), grain or pick_grain(df, ts)
    long = long_doubles(df.withColumn("_p", truncated(ts, grain)), cols, ["_p"]).where("_p is not null and value is not null")
    return long.groupBy("column", F.col("_p").alias("period")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def rolling_trend(df: DataFrame, ts: str, cols: Sequence[str] | None = None, days: int = K.ROLLING_DAYS) -> DataFrame:
    """(column, period, n, mean, rolling_mean): daily means of every numeric column and the mean of the days up to each.

    The window runs over one row per column and day with records, so it grows with the calendar and not with the rows."""
    daily = trend_lines(df, ts, cols, "day").withColumn("_d", F.datediff(F.col("period").cast("date"), F.lit("1970-01-01").cast("date")))
    last = Window.partitionBy("column").orderBy("_d").rangeBetween(1 - days, 0)
    return daily.select("column", "period", "n", "mean", (F.sum("total").over(last) / F.sum("n").over(last)).alias("rolling_mean"))


def resample(df: DataFrame, ts: str, value: str, grain: str = "day") -> DataFrame:
    """(period, n, mean) with the periods that have no record."""
    line = trend_line(df, ts, value, grain)
    span = df.agg(F.min(truncated(ts, grain)).alias("a"), F.max(truncated(ts, grain)).alias("b")).where("a is not null")
    periods = span.select(F.explode(F.sequence("a", "b", F.expr(GRAINS[grain]))).alias("period"))
    return periods.join(line, "period", "left").select(
        "period", F.coalesce("n", F.lit(0)).alias("n"), "mean"
    ).orderBy("period")


def time_trend(df: DataFrame, ts: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, slope_per_day, r, r2): linear trend of each numeric column against time."""
    cols = numeric_columns(df, cols)
    long = long_doubles(df.withColumn("_d", seconds(ts) / F.lit(float(DAY))), cols, ["_d"])
    y, x = F.col("value"), F.col("_d")
    sums = long.where(x.isNotNull() & y.isNotNull()).groupBy("column").agg(
        F.count("*").alias("n"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy")
    )
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    return sums.select("column", "n", F.try_divide("sxy", "sxx").alias("slope_per_day"), r.alias("r"), (r * r).alias("r2"))


def autocorrelation(
    df: DataFrame, value: str, order_by: str, tie: str, max_lag: int | None = None, block: int = 65_536
) -> DataFrame:
    """(lag, n, r, band95, band99) of the non-missing values in (order_by, tie) order, for every lag or for lags 0…max_lag.

    Rows get a dense index from bucketed running counts.  All lags come from a Fourier transform in three shuffles (``lag_sums``).
    For a few lags, blocks of consecutive indexes, each with the first ``max_lag`` rows
    of the next block, yield partial lag sums.  Identical rows travel as one row with a count and are spread over the
    groups they cover, so neither equal times nor copies pile up in a task.  ``order_by`` is a date, timestamp or number.  A tie key
    that is missing or no number comes before all others; rows that still tie are ordered by value."""
    numeric = order_by in numeric_columns(df)
    at = col(order_by).cast("double") if numeric else seconds(order_by)
    rows = doubles(df.select(at.alias("_t"), col(tie).try_cast("double").alias("_k"), col(value).alias("_v")), ["_v"], ["_t", "_k"])
    rows = rows.where("_v is not null and _t is not null").fillna(-sys.float_info.max, ["_k"])
    head = rows.agg(F.count("*").alias("n"), F.avg("_v").alias("m")).first()
    n, mean = head["n"], head["m"] or 0.0
    cut, buckets = cut_along(rows, "_t", "_k")
    copies = cut.groupBy(*buckets, "_t", "_k", "_v").agg(F.count("*").alias("_c"))
    placed = scan(copies, buckets, ["_t", "_k", "_v"], {"_end": "_c"}).select(
        (F.col("_end") - F.col("_c")).alias("a"), F.col("_end").alias("b"), (F.col("_v") - F.lit(mean)).alias("x")
    )
    if max_lag is None:
        sums = lag_sums(placed, n)
    else:
        sums = _block_sums(placed, max_lag, max(block, max_lag + 1)).groupBy("lag").agg(F.sum("s").alias("s"))
    total = placed.agg(F.sum((F.col("b") - F.col("a")) * F.col("x") * F.col("x")).alias("z"))
    root = float(n) ** 0.5 if n else 1.0
    return sums.select(
        F.col("lag").cast("int").alias("lag") if max_lag is not None else "lag", F.lit(n).cast("bigint").alias("n"),
        F.try_divide(F.col("s"), total.scalar()).alias("r"),
        F.lit(1.959963984540054 / root).alias("band95"), F.lit(2.5758293035489004 / root).alias("band99"),
    ).where(F.col("lag") < max(n, 1)).orderBy("lag")


def _block_sums(placed: DataFrame, lags: int, size: int) -> DataFrame:
    """(lag, s) of every block: an index i belongs to block i // size, and also to the block before when it lies within ``lags`` of the border."""
    first = F.expr(f"greatest(bigint(0), a div {size} - IF(a % {size} < {lags}, 1, 0))")
    pieces = placed.select(F.explode(F.sequence(first, F.expr(f"(b - 1) div {size}"))).alias("block"), "a", "b", "x")

    def sums_of(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf["block"].iloc[0]) * size
        series = np.zeros(size + lags)
        start = np.clip(pdf["a"].to_numpy() - lo, 0, size + lags)
        length = np.clip(pdf["b"].to_numpy() - lo, 0, size + lags) - start
        offset = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        series[np.repeat(start, length) + offset] = np.repeat(pdf["x"].to_numpy(), length)
        stop = int((start + length).max())
        own = min(stop, size)
        sums = [float(series[:own] @ series[h:own + h]) for h in range(lags + 1)]
        return pd.DataFrame({"lag": range(lags + 1), "s": sums})

    return pieces.groupBy("block").applyInPandas(sums_of, "lag int, s double")
