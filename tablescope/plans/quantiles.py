"""Exact linear-interpolation quantiles whose shuffle is a small fraction of the data.

Pass 1 asks a quantile sketch for a value safely below and one safely above each wanted rank.  Pass 2 counts the rows
between the brackets and the single values inside them.  Only the values inside the brackets (about a thousandth
of the rows each) keep their identity in the shuffle, so no task ever holds the value-to-count map of a whole column.  A
bracket that still has more distinct values than one task should sort is cut again at its own quantiles, and only the pieces
that hold a wanted rank are kept, until every piece is small (``select_ranks``)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import QUANTILES
from ..functions.columns import col, doubles, numeric_columns, small_frame
from ..session import materialize
from .ordered import cut_along, scan
from .shared import is_shared, remember
from .sketch import K_RANKS, rank_error, sketch

# A piece with more distinct values is cut at FANOUT - 1 points before its values are put in order.
PIECE_ROWS = 1_000_000
FANOUT = 64
ACCURACY = 10_000
Cuts = list[tuple[float, bool]]


def _ranks(q: float, n: int) -> tuple[int, int, float]:
    h = q * (n - 1)
    low = math.floor(h)
    return low, min(low + 1, n - 1), h - low


def _asked(q: float, k: int) -> tuple[float, float]:
    """Sketch ranks for one quantile: a bracket of twice the rank error on each side."""
    margin = 2 * rank_error(k)
    return max(0.0, q - margin), min(1.0, q + margin)


def _cuts(spans: list[list[float]]) -> Cuts:
    """(upper end, keep values) of consecutive pieces, from brackets given as increasing cut points; the last piece is open."""
    merged: list[list[float]] = []
    for span in sorted(spans):
        if merged and span[0] <= merged[-1][-1]:
            merged[-1] = sorted({*merged[-1], *span})
        else:
            merged.append(sorted(set(span)))
    cuts: Cuts = []
    for span in merged:
        cuts.append((math.nextafter(span[0], -math.inf), False))
        cuts += [(x, True) for x in (span[1:] or span)]
    return cuts


def select_ranks(counted: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """(keys…, _rank, _value) of the wanted zero-based ranks.

    ``counted`` has the keys, ``_p`` (the pieces of a key in order), ``_v`` (the distinct values of a piece, null where only their
    number is known) and ``_c`` (how often); ``ranks`` has the keys and an array ``_ranks``.  Ranks in pieces without values have no row.

    A piece with more than PIECE_ROWS values is cut into FANOUT at its own approximate quantiles.  The cuts only balance the work, as the
    new pieces are counted; pieces without a wanted rank are dropped.  Values are distinct, so the pieces shrink in every round."""
    keys, by = list(keys), [*keys, "_p"]
    before = Window.partitionBy(*[col(k) for k in keys]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    here = F.filter("_ranks", lambda r: (r >= F.col("_o")) & (r < F.col("_o") + F.col("_s")))
    counted = materialize(counted, "ranked-values")
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_s"), F.count("_v").alias("_k"))
    placed = sizes.withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).join(ranks, keys)
    held = placed.withColumn("_ranks", here).where((F.size("_ranks") > 0) & (F.col("_k") > 0))
    rows = counted.where("_v is not null")
    while (held.agg(F.max("_k")).first()[0] or 0) > PIECE_ROWS:
        inside = rows.join(held.drop("_ranks", "_s"), by)
        points = [i / FANOUT for i in range(1, FANOUT)]
        cuts = inside.where(F.col("_k") > PIECE_ROWS).groupBy(*by).agg(F.percentile_approx("_v", points, F.lit(ACCURACY)).alias("_cuts"))
        number = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).otherwise(0)
        cut = inside.join(cuts, by, "left").select(*[col(k) for k in keys], (F.col("_p") * FANOUT + number).cast("long").alias("_p"), "_v", "_c", "_o")
        rows = materialize(cut, "ranked-pieces")
        inner = Window.partitionBy(*[col(k) for k in keys], F.floor(F.col("_p") / FANOUT)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy(*by).agg(F.sum("_c").alias("_s"), F.count("_v").alias("_k"), F.min("_o").alias("_o"))
        placed = sizes.withColumn("_o", F.col("_o") + F.coalesce(F.sum("_s").over(inner), F.lit(0))).join(ranks, keys)
        held = materialize(placed.withColumn("_ranks", here).where(F.size("_ranks") > 0), "ranked-places")
        rows = rows.drop("_o")
    upto = F.col("_o") + F.sum("_c").over(Window.partitionBy(*[col(k) for k in by]).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = rows.join(held.drop("_s", "_k"), by).withColumn("_upto", upto)
    hits = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")))
    return ordered.select(*[col(k) for k in keys], F.explode(hits).alias("_rank"), F.col("_v").alias("_value"))


def _pick(df: DataFrame, cuts: dict[str, Cuts], wanted: dict[str, set[int]]) -> dict:
    """{(column number, rank): value} for the wanted zero-based ranks that lie in the kept pieces."""
    names, entries = list(cuts), []
    for i, c in enumerate(names):
        v = col(c)
        piece = F.lit(2 * len(cuts[c]))
        for j in reversed(range(len(cuts[c]))):
            upper, keep = cuts[c][j]
            piece = F.when(v <= F.lit(upper), 2 * j + int(keep)).otherwise(piece)
        entries += [F.lit(i), F.when(v.isNotNull(), piece), v]
    long = df.select(F.stack(F.lit(len(names)), *entries).alias("c", "piece", "v")).where("piece is not null")
    counted = long.groupBy("c", "piece", F.when(F.col("piece") % 2 == 1, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    ranks = small_frame(df.sparkSession, [(names.index(c), sorted(r)) for c, r in wanted.items()], "c int, _ranks array<bigint>")
    found = select_ranks(counted.select("c", F.col("piece").cast("long").alias("_p"), F.col("v").alias("_v"), F.col("n").alias("_c")), ["c"], ranks)
    hits = found.collect()
    return {(names[r["c"]], r["_rank"]): r["_value"] for r in hits}


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], k: int = K_RANKS) -> dict[str, dict[float, float | None]]:
    """{column: {q: value}}, exact; columns x quantiles numbers reach the driver and nothing else."""
    cols, probs = list(cols), [float(q) for q in probs]
    if not cols:
        return {}
    if is_shared(df) and k == K_RANKS and set(probs) <= set(QUANTILES) and set(cols) <= set(numeric_columns(df)):
        all_cols = numeric_columns(df)
        stored = remember(df, "quantiles", lambda: _column_quantiles(df, all_cols, list(QUANTILES), k))
        return {c: {q: stored[c][q] for q in probs} for c in cols}
    return _column_quantiles(df, cols, probs, k)


def _column_quantiles(df: DataFrame, cols: list[str], probs: list[float], k: int) -> dict[str, dict[float, float | None]]:
    df = doubles(df, cols)
    inner = sorted({q for q in probs if 0 < q < 1})
    asked = [r for q in inner for r in _asked(q, k)]
    stats = sketch(df, {c: asked or [0.5] for c in cols}, k)
    sizes = {c: (stats[f"n{i}"], stats[f"lo{i}"], stats[f"hi{i}"]) for i, c in enumerate(cols)}

    cuts, wanted = {}, {}
    for i, c in enumerate(cols):
        n, lo, hi = sizes[c]
        if not n or not inner or lo == hi:
            continue
        ranks = {r for q in inner for r in _ranks(q, n)[:2] if 0 < r < n - 1}
        if not ranks:
            continue
        spans = []
        for j, q in enumerate(inner):
            low_q, high_q = _asked(q, k)
            # below k rows the margin is less than a few ranks, and such a column is small: keep all of it
            low = lo if low_q == 0 or n <= k else stats[f"q{i}"][2 * j]
            high = hi if high_q == 1 or n <= k else stats[f"q{i}"][2 * j + 1]
            spans.append([low, high])
        cuts[c], wanted[c] = _cuts(spans), ranks
    values = {}
    if cuts:
        values = _pick(df, cuts, wanted)
        missed = {c: {r for r in ranks if (c, r) not in values} for c, ranks in wanted.items()}
        missed = {c: ranks for c, ranks in missed.items() if ranks}
        if missed:  # a sketch outside its error bound: keep the whole columns
            values.update(_pick(df, {c: _cuts([[sizes[c][1], sizes[c][2]]]) for c in missed}, missed))

    def value(c: str, q: float) -> float | None:
        n, lo, hi = sizes[c]
        if not n:
            return None

        def at(rank: int) -> float:
            return lo if rank == 0 or lo == hi else hi if rank == n - 1 else values[(c, rank)]

        a, b, part = _ranks(q, n)
        return at(a) + (at(b) - at(a)) * part if part else at(a)

    return {c: {q: value(c, q) for q in probs} for c in cols}


def sketched_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], k: int = K_RANKS) -> dict[str, list[float] | None]:
    """{column: values} from the sketch alone."""
    row = sketch(doubles(df, list(cols)), {c: probs for c in cols}, k)
    return {c: row[f"q{i}"] for i, c in enumerate(cols)}


# Up to SMALL * ACCURACY rows the margin of the grouped sketch is below a few ranks; such a group is taken whole (it is small).
SMALL = 2


def _edges(q: float, accuracy: int) -> tuple[float, float]:
    return max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY, stats: Mapping[str, Column] | None = None
) -> DataFrame:
    """(keys…, q0, q1, …) for any number of groups, exact, same two passes with the brackets kept as a table.

    ``stats`` are further aggregates of the value, taken in the first pass and returned beside the quantiles.

    The brackets are one row per group; the optimizer broadcasts them when they are measured to be small and joins on the
    group key otherwise (with skew splitting).  Missing keys and values are left out."""
    keys, m, stats = list(keys), len(probs), stats or {}
    rows = doubles(df, [value], keys).where(col(value).isNotNull())
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    asked = [e for q in probs for e in _edges(q, accuracy)]
    sketch = rows.groupBy(*[col(k) for k in keys]).agg(
        F.count("*").alias("_n"), F.min(col(value)).alias("_lo"), F.max(col(value)).alias("_hi"),
        F.percentile_approx(col(value), asked, accuracy).alias("_p"), *[c.alias(name) for name, c in stats.items()],
    )
    lows, highs = [], []
    for j, q in enumerate(probs):
        low_q, high_q = _edges(q, accuracy)
        small = F.col("_n") <= SMALL * accuracy
        lows.append(F.when(small | F.lit(low_q == 0), F.col("_lo")).otherwise(F.col("_p")[2 * j]).alias(f"_l{j}"))
        highs.append(F.when(small | F.lit(high_q == 1), F.col("_hi")).otherwise(F.col("_p")[2 * j + 1]).alias(f"_h{j}"))
    sketch = materialize(sketch.select(*[col(k) for k in keys], "_n", *lows, *highs, *stats), "group-brackets")
    joined = rows.join(sketch.drop(*stats), keys)
    v = col(value)
    # brackets are sorted by q, so the number of brackets wholly below v orders the rows outside them; those before a bracket come first
    passed = sum((F.when(v > F.col(f"_h{j}"), 1).otherwise(0) for j in range(m)), F.lit(0))
    low = F.coalesce(*[F.when(v <= F.col(f"_h{j}"), F.col(f"_l{j}")) for j in range(m)])
    counted = (
        joined.select(*[col(k) for k in keys], "_n", passed.alias("_b"), F.when(v >= low, v).alias("_v"))
        .groupBy(*[col(k) for k in keys], "_n", "_b", "_v")
        .agg(F.count("*").alias("_c"))
    )
    h = [F.lit(float(q)) * (F.col("_n") - 1) for q in probs]
    wanted = [(F.floor(x), F.least(F.floor(x) + 1, F.col("_n") - 1)) for x in h]
    ranks = sketch.select(*[col(k) for k in keys], F.array_distinct(F.array(*[r for pair in wanted for r in pair])).alias("_ranks"))
    piece = (2 * F.col("_b") + F.col("_v").isNotNull().cast("int")).cast("long")
    picks = select_ranks(counted.select(*[col(k) for k in keys], piece.alias("_p"), "_v", "_c"), keys, ranks)
    picks = picks.join(sketch.select(*[col(k) for k in keys], "_n", *stats), keys)
    out = [F.max(F.when(F.col("_rank") == r, F.col("_value"))).alias(f"{tag}{j}") for j, pair in enumerate(wanted) for tag, r in zip("ab", pair)]
    found = picks.groupBy(*[col(k) for k in keys], "_n", *stats).agg(*out)

    def value_at(j: int, q: float):
        h = F.lit(float(q)) * (F.col("_n") - 1)
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        missed = F.raise_error(F.lit("quantile outside its bracket; raise the accuracy")).cast("double")
        return F.when(a.isNull() | b.isNull(), missed).otherwise(a + (b - a) * (h - F.floor(h)))

    return found.select(*[col(k) for k in keys], *stats, *[value_at(j, q).alias(f"q{j}") for j, q in enumerate(probs)])


def weighted_quantiles(counts: DataFrame, value: str, weight: str, probs: Sequence[float]) -> dict[float, float | None]:
    """Quantiles of ``value`` where each distinct value stands for ``weight`` rows; values must be distinct."""
    n = counts.agg(F.sum(col(weight))).first()[0]
    if not n:
        return {float(q): None for q in probs}
    cut, buckets = cut_along(counts, value)
    ranked = scan(cut, buckets, [value], {"_upto": weight})
    wanted = sorted({r for q in probs for r in _ranks(q, n)[:2]})
    inside = [
        F.max(F.when((F.lit(r) < F.col("_upto")) & (F.lit(r) >= F.col("_upto") - col(weight)), col(value))).alias(f"r{r}")
        for r in wanted
    ]
    row = ranked.agg(*inside).first()
    out = {}
    for q in probs:
        a, b, part = _ranks(q, n)
        out[float(q)] = row[f"r{a}"] + (row[f"r{b}"] - row[f"r{a}"]) * part
    return out
