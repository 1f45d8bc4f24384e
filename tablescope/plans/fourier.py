"""The sums of products of a long series with itself at every lag, by a Fourier transform whose steps are Spark groups.

The series, padded to N = R * C with at least as many zeros, is a matrix of R rows and C columns.  Its transform is one over each column, a turn of
every element, and one over each row.  Squared and transformed back in the opposite order it gives all lags at once, so the data
is shuffled three times and the work is N log N.  A group holds some columns or rows, about GROUP elements; between groups the
matrix travels as tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import parallelism

GROUP = 1 << 20
TILES = "band int, slab int, tile binary"


def _turns(k: np.ndarray, m: np.ndarray, size: int, sign: int) -> np.ndarray:
    """exp(sign * 2 pi i k m / size) for all pairs; the product is reduced first, so long series lose no digits."""
    return np.exp(sign * 2j * np.pi * ((k[:, None] * m[None, :]) % size) / size)


def _cut(matrix: np.ndarray, width: int, axis: int) -> Iterator[tuple[int, bytes]]:
    for i, tile in enumerate(np.split(matrix, range(width, matrix.shape[axis], width), axis)):
        yield i, np.ascontiguousarray(tile).tobytes()


def lag_sums(runs: DataFrame, n: int) -> DataFrame:
    """(lag, s) for lags 0 … n - 1: the sum of x[i] * x[i + lag] of a series of ``n`` values.

    ``runs`` has (a, b, x): the value of the places from a up to b, 0 where no run says so.  A run is cut at the rows and bands of the
    matrix, so a long one is spread over many groups."""
    bits = max(2, (2 * n - 1).bit_length())
    rows, cols = 1 << bits // 2, 1 << (bits - bits // 2)
    size, parts = rows * cols, parallelism(runs.sparkSession)
    wide, tall = (max(1, min(GROUP // other, own // parts or 1)) for own, other in ((cols, rows), (rows, cols)))
    wide, tall = 1 << wide.bit_length() - 1, 1 << tall.bit_length() - 1

    by_row = runs.select("a", "b", "x", F.explode(F.sequence(F.expr(f"a div {cols}"), F.expr(f"(b - 1) div {cols}"))).alias("row"))
    inside = by_row.select(
        "row", "x", F.greatest(F.col("a") - F.col("row") * cols, F.lit(0)).alias("a"), F.least(F.col("b") - F.col("row") * cols, F.lit(cols)).alias("b"))
    by_slab = inside.select("*", F.explode(F.sequence(F.expr(f"a div {wide}"), F.expr(f"(b - 1) div {wide}"))).alias("slab"))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        slab = int(pdf["slab"].iloc[0])
        first = slab * wide
        start = np.maximum(pdf["a"].to_numpy() - first, 0)
        count = np.minimum(pdf["b"].to_numpy() - first, wide) - start
        place = np.repeat(pdf["row"].to_numpy() * wide + start - np.cumsum(count) + count, count) + np.arange(count.sum())
        matrix = np.zeros(rows * wide)
        matrix[place] = np.repeat(pdf["x"].to_numpy(dtype=float), count)
        turned = np.fft.fft(matrix.reshape(rows, wide), axis=0) * _turns(np.arange(rows), first + np.arange(wide), size, -1)
        return pd.DataFrame([(band, slab, tile) for band, tile in _cut(turned, tall, 0)], columns=["band", "slab", "tile"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        matrix = np.zeros((tall, cols), complex)
        for slab, tile in zip(pdf["slab"], pdf["tile"]):
            matrix[:, slab * wide:(slab + 1) * wide] = np.frombuffer(tile, complex).reshape(tall, wide)
        power = np.abs(np.fft.fft(matrix, axis=1)) ** 2
        turned = np.fft.ifft(power, axis=1) * _turns(band * tall + np.arange(tall), np.arange(cols), size, 1)
        return pd.DataFrame([(band, slab, tile) for slab, tile in _cut(turned, wide, 1)], columns=["band", "slab", "tile"])

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        slab = int(pdf["slab"].iloc[0])
        matrix = np.zeros((rows, wide), complex)
        for band, tile in zip(pdf["band"], pdf["tile"]):
            matrix[band * tall:(band + 1) * tall] = np.frombuffer(tile, complex).reshape(tall, wide)
        sums = np.fft.ifft(matrix, axis=0).real.ravel()
        lag = (np.arange(rows)[:, None] * cols + slab * wide + np.arange(wide)).ravel()
        return pd.DataFrame({"lag": lag[lag < n], "s": sums[lag < n]})

    columns = by_slab.groupBy("slab").applyInPandas(down, TILES)
    return columns.groupBy("band").applyInPandas(across, TILES).groupBy("slab").applyInPandas(up, "lag long, s double")
