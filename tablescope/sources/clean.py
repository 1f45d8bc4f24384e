"""Load-time cleaning: missing-value tokens, numbers in text, dates in text, column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..functions.columns import col, rows_from


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def normalize_missing(df: DataFrame, tokens: Sequence[str] = K.MISSING_TOKENS) -> DataFrame:
    """Missing-value tokens in string columns and NaN in float columns become null."""
    from ..functions.columns import merge_nan

    return merge_nan(_replace(df, {c: F.when(~col(c).isin(*tokens), col(c)) for c in _strings(df)}))


def to_number(text: Column) -> Column:
    """Double or null.  A trailing d or f, which the JVM takes as a type suffix, is not a number."""
    t = F.trim(text)
    return F.when(~t.rlike(r"(?i)^[+-]?[\d.].*[df]$|^[+-]?0x"), t.try_cast("double"))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as doubles; text that is no number becomes null."""
    return _replace(df, {c: to_number(col(c).cast("string")) for c in cols})


def _losses(df: DataFrame, new: dict[str, Column], name: str) -> DataFrame:
    """(column, n, <name>): non-missing values, and those whose new value is missing; one scan."""
    wide = df.agg(*[x for i, (c, value) in enumerate(new.items()) for x in (
        F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).isNotNull() & value.isNull()).alias(f"b{i}"))])
    return rows_from(wide, [(F.lit(c), F.col(f"n{i}"), F.col(f"b{i}")) for i, c in enumerate(new)], ["column", "n", name])


def coercion_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, coerced): non-missing values, and those that coerce_numeric would lose."""
    return _losses(df, {c: to_number(col(c).cast("string")) for c in cols}, "coerced")


def datetime_report(df: DataFrame, cols: Sequence[str] | None = None, formats: Sequence[str] = K.DATE_FORMATS) -> DataFrame:
    """(column, n, lost): non-missing values of string columns, and those that parse_datetimes would lose if it took the column."""
    return _losses(df, {c: to_time(col(c), formats) for c in cols or _strings(df)}, "lost")


def schema_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, n, lost): non-missing values, and those that do not fit the declared schema."""
    return _losses(df, _fitted(schema), "lost")


def to_time(text: Column, formats: Sequence[str] = K.DATE_FORMATS) -> Column:
    """Timestamp without zone by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_datetimes(
    df: DataFrame, cols: Sequence[str] | None = None, formats: Sequence[str] = K.DATE_FORMATS, share: float = K.DATE_PARSE_SHARE
) -> DataFrame:
    """String columns of which at least ``share`` of the values parse become timestamps; one scan decides."""
    cols = list(cols or _strings(df))
    if not cols:
        return df
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(col(c)).alias(f"n{i}"), F.count(to_time(col(c), formats)).alias(f"t{i}"))]).first()
    dates = [c for i, c in enumerate(cols) if row[f"n{i}"] and row[f"t{i}"] >= share * row[f"n{i}"]]
    return _replace(df, {c: to_time(col(c), formats) for c in dates})


_LOGICAL = r"(?i)^(true|false)$"
_ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-string columns the narrowest of bigint, double, boolean, timestamp that every value fits; one scan."""
    cols = _strings(df)
    if not cols:
        return df
    tests = lambda c: (
        c.try_cast("bigint"), to_number(c), F.when(c.rlike(_LOGICAL), c), F.when(c.rlike(_ISO), c.try_cast("timestamp_ntz"))
    )
    row = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.count(t).alias(f"t{i}_{j}") for i, c in enumerate(cols) for j, t in enumerate(tests(col(c)))],
    ).first()
    new = {}
    for i, c in enumerate(cols):
        fits = [j for j in range(4) if row[f"n{i}"] and row[f"t{i}_{j}"] == row[f"n{i}"]]
        if fits:
            kind = ("bigint", "double", "boolean", "timestamp_ntz")[fits[0]]
            new[c] = to_number(col(c)) if kind == "double" else col(c).try_cast(kind)
    return _replace(df, new)


def _fitted(schema: T.StructType) -> dict[str, Column]:
    floats = (T.DoubleType, T.FloatType)
    return {f.name: to_number(col(f.name)).cast(f.dataType) if isinstance(f.dataType, floats) else col(f.name).try_cast(f.dataType) for f in schema.fields}


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast string columns to a declared schema; values that do not fit become null (``schema_report`` counts them)."""
    return df.select(*[value.alias(name) for name, value in _fitted(schema).items()])
