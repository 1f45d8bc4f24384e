"""Exact value frequencies of many columns in one shuffle.

Each cell becomes ``(column, l, d, s)``: integers, booleans, dates and timestamps in the long slot, floats in the double
slot, everything else as text.  Typed slots avoid formatting numbers as text.  The first aggregate combines on the map side, so a
value that fills a third of the table travels once per task.  Where only the number of distinct values and the top count are
wanted, a text travels as a 128-bit fingerprint in two long slots ``l`` and ``m``, so long texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import clock, col, merge_nan, micros, profiled, with_all_columns
from ..session import materialize
from .shared import is_shared, on_driver, remember

KEY = ("l", "d", "s")
SHORT_KEY = ("l", "d", "m")


def _is_text(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.FloatType, T.DoubleType))


def _fingerprint(c: Column) -> tuple[Column, Column]:
    """Two hashes of the text of a value; null for null, whose hash is not null."""
    text = c.cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit(7919), text))


def _slots(field: T.StructField, hashed: bool) -> list[Column]:
    c, kind = col(field.name), field.dataType
    last = "bigint" if hashed else "string"
    empty = {"l": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast(last)}
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        empty["l"] = c.cast("bigint")
    elif isinstance(kind, T.DateType):
        empty["l"] = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        empty["l"] = micros(c)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        empty["d"] = c.cast("double")
    elif hashed:
        empty["l"], empty["s"] = _fingerprint(c)
    else:
        empty["s"] = c.cast("string")
    return [F.lit(field.name), *empty.values()]


def cells(df: DataFrame, cols: Sequence[str], hashed: bool = False) -> DataFrame:
    """(column, l, d, s) or, hashed, (column, l, d, m) for every non-missing cell."""
    clean, key = merge_nan(df.select(*[col(c) for c in cols])), SHORT_KEY if hashed else KEY
    slots = [x for f in clean.schema.fields for x in _slots(f, hashed)]
    return clean.select(F.stack(F.lit(len(cols)), *slots).alias("column", *key)).where(
        f"l is not null or d is not null or {key[2]} is not null"
    )


def frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, l, d, s, n): every distinct value of every column with its number of rows."""
    return cells(df, list(cols or profiled(df))).groupBy("column", *KEY).agg(F.count("*").alias("n"))


def value_text(df: DataFrame, cols: Sequence[str], own: Column | None = None) -> Column:
    """The text of a frequency key, in the form its column prints; ``own`` is the text of a text column."""
    text = F.coalesce(F.col("s") if own is None else own, F.col("d").cast("string"), F.col("l").cast("string"))
    if own is not None:  # the slots of a text hold its fingerprint
        text = F.when(own.isNotNull(), own).otherwise(text)
    for f in df.select(*[col(c) for c in cols]).schema.fields:
        here = F.col("column") == F.lit(f.name)
        if isinstance(f.dataType, T.BooleanType):
            text = F.when(here, (F.col("l") == 1).cast("string")).otherwise(text)
        elif isinstance(f.dataType, T.DateType):
            text = F.when(here, F.date_from_unix_date(F.col("l").cast("int")).cast("string")).otherwise(text)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            time = F.timestamp_micros("l") if isinstance(f.dataType, T.TimestampType) else clock(F.col("l"))
            text = F.when(here, time.cast("string")).otherwise(text)
    return text


def distinct_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, uniques, freq): per column the rows, the distinct values and the count of the most frequent one.

    Both aggregates are hash aggregates that combine before they shuffle."""
    cols, known = list(cols or profiled(df)), profiled(df)
    if is_shared(df) and set(cols) <= set(known):
        return remember(df, "distinct", lambda: on_driver(_distinct_summary(df, known))).where(F.col("column").isin(cols))
    return _distinct_summary(df, cols)


def _distinct_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = cells(df, cols, hashed=True).groupBy("column", *SHORT_KEY).agg(F.count("*").alias("n"))
    core = counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.count("*").alias("uniques"), F.max("n").alias("freq")
    )
    return with_all_columns(core, cols).select(
        "column", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("uniques", F.lit(0)).alias("uniques"), "freq"
    )


#: Characters of a text that travel with its fingerprint, to settle most ties without the text.
PREFIX = 16
SALTS = 64


def top_values(df: DataFrame, cols: Sequence[str], top: int, natural: bool = False) -> DataFrame:
    """(column, value, n, rank): the ``top`` most frequent values of each column, ties in the order of their text (``natural``: of the value).

    Texts are counted by fingerprint and the first characters.  Only the winners, and values that tie with the last of them in count
    and first characters, are looked up in the table again, so no exchange carries the texts of a column.  Ranks are taken in SALTS parts of a column and
    then over what is left of them, whatever ``top`` is."""
    cols = list(cols)
    clean = merge_nan(df.select(*[col(c) for c in cols]))
    texts = [f.name for f in clean.schema.fields if _is_text(f.dataType)]
    keys = ["column", *SHORT_KEY, "p"]
    slots = [x for f in clean.schema.fields for x in (
        *_slots(f, True), F.substring(col(f.name).cast("string"), 1, PREFIX) if f.name in texts else F.lit(None).cast("string"))]
    long = clean.select(F.stack(F.lit(len(cols)), *slots).alias(*keys)).where("l is not null or d is not null")
    counts = long.groupBy(*keys).agg(F.count("*").alias("n"))
    shown = value_text(df, cols, F.col("p"))
    numbers = [F.when(F.col("p").isNull(), F.col(k)) for k in ("l", "d")] if natural else []
    order = [F.desc("n"), *numbers, shown]
    part = Window.partitionBy("column", F.pmod(F.xxhash64("l", "d", "m"), F.lit(SALTS))).orderBy(*order)
    first = counts.withColumn("_r", F.rank().over(part)).where(F.col("_r") <= top)
    best = first.withColumn("_r", F.rank().over(Window.partitionBy("column").orderBy(*order))).where(F.col("_r") <= top).drop("_r")
    if texts:
        best = materialize(best, "top-values")
        wanted = best.where("p is not null").select("column", "l", "m")
        parts = [x for c in texts for x in (F.lit(c), *_fingerprint(col(c)), col(c).cast("string"))]
        cells = clean.select(F.stack(F.lit(len(texts)), *parts).alias("column", "l", "m", "s")).where("s is not null")
        found = cells.join(wanted, ["column", "l", "m"], "left_semi").distinct()
        best = best.join(found, ["column", "l", "m"], "left")
    else:
        best = best.withColumn("s", F.lit(None).cast("string"))
    value = value_text(df, cols, F.col("s"))
    order = [F.desc("n"), *numbers, "value"]
    ranked = best.withColumn("value", value).withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("column", "value", "n", "rank")


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, top, freq): the most frequent value of each column, the smallest of equally frequent ones."""
    best = top_values(df, cols, 1, natural=True).select("column", F.col("value").alias("top"), F.col("n").alias("freq"))
    return with_all_columns(best, cols)
