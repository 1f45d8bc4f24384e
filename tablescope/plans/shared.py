"""Results that several analyses of one run need are computed once.

Inside ``shared_results(df)`` the moments, quantiles, frequencies summary, null counts and correlations of ``df`` are computed for all
its columns on first use and kept on the driver; their size depends on the number of columns only.  A full profile then scans the
table once per kind of result instead of once per analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import DataFrame

from ..functions.columns import small_frame

_ACTIVE: ContextVar[tuple[DataFrame, dict] | None] = ContextVar("shared_results", default=None)
R = TypeVar("R")


@contextmanager
def shared_results(df: DataFrame) -> Iterator[None]:
    active = _ACTIVE.get()
    if active and active[0] is df:
        yield
        return
    token = _ACTIVE.set((df, {}))
    try:
        yield
    finally:
        _ACTIVE.reset(token)


def is_shared(df: DataFrame) -> bool:
    active = _ACTIVE.get()
    return active is not None and active[0] is df


def remember(df: DataFrame, key: str, make: Callable[[], R]) -> R:
    """The stored result of ``make`` for the active table."""
    memo = _ACTIVE.get()[1]
    if key not in memo:
        memo[key] = make()
    return memo[key]


def on_driver(result: DataFrame) -> DataFrame:
    """A small result as a local table."""
    return small_frame(result.sparkSession, [tuple(r) for r in result.collect()], result.schema)
