"""Isolation forest (Liu, Ting and Zhou, 2008): trees are grown in parallel tasks on small samples, scoring is vectorised."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.columns import col, doubles, numeric_columns
from ..plans.quantiles import column_quantiles
from ..plans.sampling import lowest_by_hash
from ..session import materialize

TREES, SAMPLE = 100, 256
EULER = 0.5772156649


def mean_path(m: float) -> float:
    """Average path length of an unsuccessful search among m points."""
    return 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (math.log(m - 1) + EULER) - 2 * (m - 1) / m


def grow(x: np.ndarray, seed: int) -> pd.DataFrame:
    """One tree as a node table: feature (-1 for a leaf), cut, left child (right is left + 1), depth incl. leaf correction."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = [[-1, 0.0, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes[node][3] = depth + mean_path(len(rows))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= cut
        left = len(nodes)
        nodes[node][:3] = [f, cut, left]
        nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
        todo += [(left, rows[below], depth + 1), (left + 1, rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=["feature", "cut", "child", "depth"])


def path_lengths(x: np.ndarray, tree: tuple[np.ndarray, ...], levels: int) -> np.ndarray:
    """Path length of every row.  A leaf leads to itself, so all rows take the same number of steps without a mask."""
    feature, cut, child, depth = tree
    flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), dtype=np.intp)
    for _ in range(levels):
        at = child.take(at) + (flat.take(start + feature.take(at)) > cut.take(at))
    return depth.take(at)


def as_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """A node table with leaves that lead to themselves."""
    leaf = (nodes["feature"] < 0).to_numpy()
    return (
        np.where(leaf, 0, nodes["feature"]).astype(np.intp), np.where(leaf, np.inf, nodes["cut"]),
        np.where(leaf, np.arange(len(nodes)), nodes["child"]).astype(np.intp), nodes["depth"].to_numpy(dtype=float),
    )


def isolation_forest(
    df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None, contamination: float = K.FOREST_CONTAMINATION,
    seed: int = K.FOREST_SEED, trees: int = TREES, sample: int = SAMPLE,
) -> DataFrame:
    """(key…, score, is_outlier) for the complete rows; the highest ``contamination`` share of the scores is flagged.

    The sample is the trees x sample rows with the lowest hash of the key, so it does not depend on the partitioning;
    the key should identify rows.  The forest has at most trees x 4 x sample nodes, which bounds what is collected and shipped.
    Scores are written once to the shared folder, because the cut (an exact quantile) and the result both need them."""
    key = list(key)
    cols = [c for c in numeric_columns(df, cols) if c not in key]
    names = [f"f{i}" for i in range(len(cols))]
    rows = doubles(df, cols, key).dropna(subset=cols).select(
        *[col(k) for k in key], *[col(c).alias(n) for c, n in zip(cols, names)]
    )
    drawn = lowest_by_hash(rows, key, trees * sample, seed).withColumn(
        "tree", F.pmod(F.xxhash64(F.lit(seed + 1), *[col(k) for k in key]), F.lit(trees)).cast("int")
    )

    def grow_one(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        x = pdf[names].to_numpy(dtype=float)
        x = x[np.lexsort(x.T[::-1])]  # same tree whatever order the rows arrive in
        node_table = grow(x, seed * 100_003 + number)
        return node_table.assign(tree=number, node=range(len(node_table)), size=len(x))

    schema = "feature int, cut double, child int, depth double, tree int, node int, size int"
    table = drawn.groupBy("tree").applyInPandas(grow_one, schema).toPandas()
    forest, sizes = [], []
    for _, part in table.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(as_arrays(part))
        sizes.append(int(part["size"].iloc[0]))
    if not forest:
        return rows.select(*[col(k) for k in key], F.lit(0.0).alias("score"), F.lit(False).alias("is_outlier"))
    norm = max(mean_path(sum(sizes) / len(sizes)), 1e-9)
    levels = math.ceil(math.log2(max(*sizes, 2)))
    shipped = df.sparkSession.sparkContext.broadcast(forest)

    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            columns = series if isinstance(series, tuple) else (series,)  # one column comes without a tuple
            x = np.ascontiguousarray(np.column_stack([s.to_numpy(dtype=float) for s in columns]))
            depth = sum(path_lengths(x, t, levels) for t in shipped.value) / len(shipped.value)
            yield pd.Series(np.exp2(-depth / norm))

    udf = F.pandas_udf(score_hints(score), "double")
    scored = materialize(rows.select(*[col(k) for k in key], udf(*[F.col(n) for n in names]).alias("score")), "forest-scores")
    cut = column_quantiles(scored, ["score"], [1 - contamination])["score"][1 - contamination]
    return scored.withColumn("is_outlier", F.col("score") > F.lit(0.0 if cut is None else cut))


def score_hints(function):
    """Give the closure the evaluated type hints pandas_udf reads."""
    function.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return function
