"""Exact average ranks, from counts per distinct value or of all columns of a table at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import col, merge_nan
from ..session import parallelism
from .ordered import scan, split_points, with_buckets

#: The least number of pieces a column is cut into; a value that is a split point is ranked without being moved.
PIECES = 256
#: Values of a piece; a column with larger ones is cut again.
PIECE_ROWS = 4_000_000
#: Rows whose values travel together.
BLOCK = 1 << 16
View = tuple[str, str | None]


def ranked_values(rows: DataFrame, value: str, splits: Sequence[float], group: str | None = None) -> DataFrame:
    """(_value[, _group], n, ties, rank): average rank of each distinct value among all non-missing rows.

    With ``group`` there is one row per value and group; the rank is over all groups and ``ties`` counts the value in all."""
    keys = ["_value"] + (["_group"] if group else [])
    rows = rows.select(col(value).alias("_value"), *([col(group).alias("_group")] if group else [])).dropna(subset=keys)
    bucket = "_b__value"
    counts = with_buckets(rows, {"_value": list(splits)}).groupBy(bucket, *keys).agg(F.count("*").alias("n"))
    run = scan(counts, [bucket], ["_value"], {"_upto": "n"}, peers=True)
    ties = F.sum("n").over(Window.partitionBy(bucket, "_value")) if group else F.col("n")
    return run.withColumn("ties", ties).select(
        *keys, "n", "ties", (F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)).alias("rank")
    )


def _codes(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The piece of each value: odd between two split points, even for a value that equals one, -1 for a missing one."""
    place = np.searchsorted(cut, x, side="right")
    single = (np.append(cut, np.nan)[place - 1] == x) & (place > 0)
    kind = np.int16 if 2 * len(cut) + 2 < 1 << 15 else np.int32
    return np.where(np.isnan(x), -1, 2 * place + ~single).astype(kind)


def _viewed(batch: pa.RecordBatch | pa.Table, views: Sequence[tuple[int, int | None]], cuts: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and pieces of each view, given by the places of its columns."""
    values = [batch.column(i).to_numpy(**({} if isinstance(batch, pa.Table) else {"zero_copy_only": False})) for i in range(len(cuts))]
    codes = [_codes(x, cut) for x, cut in zip(values, cuts)]
    for a, b in views:
        yield values[a], codes[a] if b is None else np.where(np.asarray(batch.column(b)), codes[a], codes[a].dtype.type(-1))


def _piece_sizes(base: DataFrame, views: Sequence[tuple[int, int | None]], cuts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The number of values in each piece of each view."""
    width = [2 * len(cuts[a]) + 2 for a, _ in views]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(w, np.int64) for w in width]
        for batch in batches:
            for total, (_, code) in zip(sums, _viewed(batch, views, cuts)):
                total += np.bincount(code[code >= 0], minlength=len(total))
        for i, total in enumerate(sums):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"view": pa.array(np.full(len(used), i, np.int32)), "piece": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    sizes = [np.zeros(w, np.int64) for w in width]
    for row in base.mapInArrow(counted, "view int, piece int, n long").groupBy("view", "piece").agg(F.sum("n").alias("n")).collect():
        sizes[row["view"]][row["piece"]] = row["n"]
    return sizes


_MOVED = "block long, view int, rows binary, data binary"


def _dealt(views: Sequence[tuple[int, int | None]], cuts: Sequence[np.ndarray], names: Sequence[str], stride: int):
    """The values of BLOCK rows at a time, a record for each piece of a view, and a record with the pieces of all views and the named columns."""

    def dealt(table: pa.Table, block: int) -> pa.RecordBatch:
        out, home = [], {}
        for i, (values, code) in enumerate(_viewed(table, views, cuts)):
            home[f"c{i}"] = pa.array(code)
            rows = np.flatnonzero((code & 1 == 1) & (code >= 0))
            rows = rows[np.argsort(code[rows], kind="stable")]
            sorted_code, sorted_values = code[rows], values[rows]
            begin = np.flatnonzero(np.diff(sorted_code, prepend=-1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)]):
                out.append((i * stride + int(sorted_code[a]), block, i, rows[a:b].astype("<u4").tobytes(), sorted_values[a:b].tobytes()))
        kept = pa.table({**home, **{n: table.column(n) for n in names}}).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as writer:
            writer.write_table(kept)
        out.append((-1 - block, block, -1, b"", sink.getvalue().to_pybytes()))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["piece", "block", "view", "rows", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield dealt(pa.Table.from_batches(held), block)
                held, n, block = [], 0, block + 1
        if n:
            yield dealt(pa.Table.from_batches(held), block)

    return run


def _ranked_piece(starts: Sequence[np.ndarray], stride: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        piece, table = key[0].as_py(), table.drop_columns(["piece"])
        if piece < 0:
            return table
        parts = [np.frombuffer(x, "<f8") for x in table.column("data").to_pylist()]
        _, place, ties = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        rank = (starts[piece // stride][piece % stride] + np.cumsum(ties) - (ties - 1) / 2)[place]
        ends = np.cumsum([len(x) for x in parts]).tolist()
        data = [rank[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return table.set_column(3, "data", pa.array(data, pa.binary()))

    return run


def _met_again(starts: Sequence[np.ndarray], sizes: Sequence[np.ndarray], names: Sequence[str]):
    def run(table: pa.Table) -> pa.Table:
        records = list(zip(*[table.column(c).to_pylist() for c in ("view", "rows", "data")]))
        home = pa.ipc.open_stream(next(data for view, _, data in records if view < 0)).read_all()
        ranks = []
        for i, (start, size) in enumerate(zip(starts, sizes)):
            code = home.column(f"c{i}").to_numpy()
            single = np.where(np.arange(len(size)) % 2 == 0, start + (size + 1) / 2, np.nan)
            ranks.append(np.where(code >= 0, single[code], np.nan))
        for view, rows, data in records:
            if view >= 0:
                ranks[view][np.frombuffer(rows, "<u4")] = np.frombuffer(data, "<f8")
        return pa.table({**{f"r{i}": pa.array(r, from_pandas=True) for i, r in enumerate(ranks)}, **{n: home.column(n) for n in names}})

    return run


def rank_columns(df: DataFrame, views: Sequence[View], keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``df`` with columns r0, r1, …: the average rank of each view's value among all its non-missing values.

    A view is a numeric column, or one on the rows where a second column of any type is not missing.  Whatever the number of views, values
    are moved twice: those between two split points meet in their piece, where they are sorted, and all ranks of a row meet again.  The
    values of BLOCK rows travel together, as one record for each piece.  A value that equals a split point is ranked from the
    table of piece counts alone, so frequent values are not moved at all.  ``keep`` names columns to carry along, as text, in k0, k1, …"""
    views, keep = list(views), list(keep)
    cols, partners = sorted({a for a, _ in views}), sorted({b for _, b in views if b is not None})
    clean = merge_nan(df.select(*[col(c) for c in dict.fromkeys([*cols, *partners, *keep])]))
    names = [f"k{i}" for i in range(len(keep))]
    base = clean.select(
        *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *[col(b).isNotNull().alias(f"h{i}") for i, b in enumerate(partners)],
        *[col(c).cast("string").alias(n) for n, c in zip(names, keep)])
    at = [(cols.index(a), None if b is None else len(cols) + partners.index(b)) for a, b in views]
    pieces, again = max(PIECES, 2 * parallelism(df.sparkSession)), 2
    while True:
        splits = split_points(base, [f"x{i}" for i in range(len(cols))], pieces)
        cuts = [np.array([p for p in points if p == p], dtype=float) for points in splits.values()]
        sizes = _piece_sizes(base, at, cuts)
        largest = max((int(n[1::2].max()) for n in sizes), default=0)
        if largest <= PIECE_ROWS or not again:
            break
        pieces, again = pieces * -(-2 * largest // PIECE_ROWS), again - 1
    starts = [np.cumsum(n) - n for n in sizes]
    stride = max((len(n) for n in sizes), default=1)
    dealt = base.mapInArrow(_dealt(at, cuts, names, stride), f"piece long, {_MOVED}")
    ranked = dealt.groupBy("piece").applyInArrow(_ranked_piece(starts, stride), _MOVED)
    fields = [f"r{i} double" for i in range(len(views))] + [f"{n} string" for n in names]
    return ranked.groupBy("block").applyInArrow(_met_again(starts, sizes, names), ", ".join(fields))
