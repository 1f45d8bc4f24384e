"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
Entry = tuple[Query, str | None]

LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that two engines with different summation orders agree; the offset settles exact halves and -0.0."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`") + F.lit(1e-9), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def r(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + 1e-9::DOUBLE, {digits})"


def union_all(parts: Iterable[str]) -> str:
    return " UNION ALL ".join(parts)


def on(name: str, operator: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    """A query that applies an operator to one table."""
    return lambda spark, sf: rounded(operator(table(spark, sf, name)), digits)
