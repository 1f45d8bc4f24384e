"""Column helpers: one notion of "missing", column classes, and row-shaped results from one wide aggregate row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NUMERIC, CATEGORICAL, DATETIME, OTHER = "numeric", "categorical", "datetime", "other"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def class_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.BooleanType)):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if class_of(f.dataType) in classes]


def profiled(df: DataFrame) -> list[str]:
    """Every column the profile covers; nested columns stay out."""
    return columns_of(df, NUMERIC, CATEGORICAL, DATETIME)


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    return list(cols) if cols is not None else columns_of(df, NUMERIC)


def merge_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column, so both count as missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.nanvl(col(c), F.lit(None)).alias(c) if c in floats else col(c) for c in df.columns])


def doubles(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The given columns as doubles, missing merged; nothing else is read."""
    return merge_nan(df.select(*[col(c) for c in keep], *[col(c).cast("double").alias(c) for c in cols]))


def long_doubles(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value): one row per cell.  Aggregating this form keeps the generated code small enough
    for the JIT; a single aggregate with all columns side by side is several times slower."""
    return doubles(df, cols, keep).unpivot([col(k) for k in keep], [col(c) for c in cols], "column", "value")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time: of the instant for a timestamp, of the clock's reading for one without zone or a date.

    A reading is put together from its parts, because a cast to an instant would move or merge the readings around a change of the
    clock in the session's zone."""
    n = c.cast("timestamp_ntz")
    parts = (F.hour(n).cast("bigint") * 60 + F.minute(n)) * 60 + F.second(n)
    below = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
    reading = (F.unix_date(n.cast("date")).cast("bigint") * 86_400 + parts) * 1_000_000 + below
    return F.when(F.typeof(c) == "timestamp", F.unix_micros(c.cast("timestamp"))).otherwise(reading)


def clock(since_1970: Column) -> Column:
    """The reading without zone so many microseconds after that of 1970-01-01."""
    epoch, second = F.lit("1970-01-01").cast("date").cast("timestamp_ntz"), F.lit(1_000_000)
    rest = F.pmod(since_1970, F.lit(86_400_000_000)).cast("decimal(18,0)") / second
    return epoch + F.make_dt_interval(F.floor(since_1970 / F.lit(86_400_000_000)).cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))


def seconds(name: str) -> Column:
    """Microseconds since 1970 of a date or timestamp column."""
    return micros(col(name))


def rows_from(df: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row frame into len(entries) rows."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(entry, names)]) for entry in entries]
    return df.select(F.inline(F.array(*structs)))


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A driver-made table whose size depends on the schema of the input only (columns, quantiles).

    Built through Arrow, which plans as a local table; a list of rows would become an RDD scan with a task per core."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=kind.names, dtype=object), kind)


def with_all_columns(result: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per listed column, also where the input had no row at all."""
    names = small_frame(result.sparkSession, [(c,) for c in cols], "column string")
    return names.join(result, "column", "left")
