"""Mix sources to target weights: dependent rounding by pivots, combined in a tree.

Each document of a source gets the same expected number of copies, target / size of the source.  The whole part is taken outright; the
fractions are rounded together.  Two units with fractions exchange words until one of them is whole; who gains is drawn so that every
expectation stays.  The words taken from the source stay the same in every exchange, so only the last fraction is rounded alone.  A
source is cut into blocks of documents; what is left of each block, one small document at most, goes to the next level of the tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import parallelism
from .scratch import stored
from .texts import word_count

BLOCK = 2048
UNIT = "source_no long, doc long, nameless boolean, size long, rows long, p double"


def source_table(sizes: DataFrame) -> DataFrame:
    """(source, source_no, n_units, source_size) from rows (source, size, rows); numbers follow code points, null last.

    Sources are numbered piece by piece of their order: only one count for each piece reaches the driver."""
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    ranged = sources.repartitionByRange(parallelism(spark), F.col("source").asc_nulls_last()).withColumn("piece", F.spark_partition_id())
    ranged = stored(ranged, "sources")
    counts = sorted((r["piece"], r["n"]) for r in ranged.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, [F.lit(-1), F.lit(0)]
    for piece, n in counts:
        starts += [F.lit(piece), F.lit(before)]
        before += n
    rank = F.row_number().over(Window.partitionBy("piece").orderBy(F.col("source").asc_nulls_last()))
    number = (F.element_at(F.create_map(*starts), F.col("piece")) + rank - 1).cast("long")
    return ranged.select("source", number.alias("source_no"), "n_units", "source_size")


def with_targets(sources: DataFrame, weight: Column, cap: float, share: float = 1.0) -> DataFrame:
    """Adds ``target``: ``share`` of all words divided by weight, no source above ``cap`` times its size, the excess divided again.

    The level (words for a weight of one) only rises, so each round needs two sums and one number from the driver."""
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    total, level, raised = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0, True
    while raised and total:
        full = F.col("weight") * level > F.col("most") if level else F.lit(False)
        row = sources.agg(F.sum(F.when(full, F.col("most"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        after = (total * share - (row["fixed"] or 0)) / row["open"] if row["open"] else level
        raised, level = after > level, max(level, after)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))).drop("most")


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the fractions in order; the sum of p * size stays, at most one fraction is left."""
    p, draws = p.astype(float), rng.random(len(p))
    values, sizes = p.tolist(), size.astype(float).tolist()
    held = None
    for j, draw in enumerate(draws.tolist()):
        if not 0 < values[j] < 1:
            continue
        if held is None:
            held = j
            continue
        a, b, sa, sb = values[held], values[j], sizes[held], sizes[j]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        if draw * (up + down) < down:
            moved, a_whole = up, (1 - a) * sa <= b * sb
            values[held], values[j] = (1.0 if a_whole else a + moved / sa), (b - moved / sb if a_whole else 0.0)
        else:
            moved, a_whole = down, a * sa <= (1 - b) * sb
            values[held], values[j] = (0.0 if a_whole else a - moved / sa), (b + moved / sb if a_whole else 1.0)
        held = j if 0 < values[j] < 1 else held if 0 < values[held] < 1 else None
    return np.array(values)


def settle(fraction: float, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round documents of one common fraction, given in falling order of size: each is paired with all that follow, taken as one unit.

    The pair exchanges words as in ``pivot``; the unit's fraction stays common to its members.  Large documents are whole while the unit
    can still absorb the difference, so the fraction that is left belongs to one of the smallest."""
    sizes, p = size.astype(float).tolist(), []
    room, f = sum(sizes), float(fraction)
    for s, draw in zip(sizes, rng.random(len(sizes)).tolist()):
        room -= s
        up, down = min((1 - f) * s, f * room), min(f * s, (1 - f) * room)
        if room <= 0 or not 0 < f < 1:
            p.append(f)
        elif draw * (up + down) < down:
            p.append(1.0 if up < f * room else f + up / s)
            f = f - up / room if up < f * room else 0.0
        else:
            p.append(0.0 if down < (1 - f) * room else f - down / s)
            f = f + down / room if down < (1 - f) * room else 1.0
    return np.array(p)


def _round_block(seed: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weight = (rows["size"] * rows["rows"]).to_numpy()
        rows = rows.iloc[np.lexsort((rows["doc"], rows["nameless"], rows["size"], -weight))].reset_index(drop=True)
        key = [seed, level, int(rows["source_no"].iloc[0]), int(rows["block"].iloc[0])]
        p, size, rng = rows["p"].to_numpy(), (rows["size"] * rows["rows"]).to_numpy(), np.random.default_rng(key)
        rows["p"] = settle(p[0], size, rng) if level == 0 else pivot(p, size, rng)
        return rows.drop(columns="block")

    return run


def _rounded(units: DataFrame, seed: int) -> DataFrame:
    """The units with p 0 or 1.  A level rounds blocks of about BLOCK units; what is left of each block goes to the next level."""
    done, open_units, level = [], units.where("p > 0 and p < 1 and size > 0"), 0
    done.append(units.where("p <= 0 or p >= 1 or size <= 0").withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0)))
    while True:
        counts = open_units.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        blocks = F.ceil(F.col("n") / BLOCK)
        spread = open_units.join(stored(counts, "mix-counts"), "source_no")
        spread = spread.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc", "size", "nameless"), blocks).cast("long")).drop("n")
        rounded = stored(spread.groupBy("source_no", "block").applyInPandas(_round_block(seed, level), UNIT), "mix-level")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.where(~fraction))
        open_units = rounded.where(fraction)
        level += 1
        if most <= BLOCK:  # one block for each source, so one fraction at most is left of each
            draw = F.pmod(F.xxhash64(F.lit(seed), "source_no", "doc", "size"), F.lit(1 << 30)) / (1 << 30)
            done.append(open_units.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)))
            break
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def mix_sources(
    docs: DataFrame, weight: Column | None = None, cap: float = 3.0, share: float = 1.0, seed: int = 42, text: str = "text",
    key: str = "doc_id", source: str = "source", size: Column | None = None,
) -> DataFrame:
    """(key, source, size, rows, source_size, target, copies) for each distinct (key, source, size) of ``docs``.

    ``size`` is the number of words (null text: 0).  ``weight`` is an expression over ``source_no``, by default 1, 2, 3 repeating along the
    sources in code point order, null last.  ``rows`` counts repeated rows, which all get the same ``copies``; a null key is a key of
    its own.  A source without words has target 0, its texts 0 copies.  An empty table gives an empty result; further columns are
    ignored.  The draws depend on the rows and the seed only, so reruns agree."""
    weight = F.col("source_no") % 3 + 1 if weight is None else weight
    size = word_count(F.col(text)) if size is None else size
    units = docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), size.alias("size"))
    units = stored(units.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    sources = stored(with_targets(source_table(units), weight, cap, share), "mix-sources")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.join(sources, units["source"].eqNullSafe(sources["source"])).select(
        "source_no", F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("nameless"), "size", "rows",
        (expected - F.floor(expected)).alias("p"),
    )
    rounded = _rounded(stored(joined, "mix-fractions"), seed)
    return rounded.join(sources, "source_no").select(
        F.when(~F.col("nameless"), F.col("doc")).alias(key), F.col("source").alias(source), "size", "rows", "source_size", "target",
        (F.floor(expected) + F.col("p").cast("long")).cast("long").alias("copies"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it; the options are those of ``mix_sources``."""
    text, key, source = (options.get(k, d) for k, d in (("text", "text"), ("key", "doc_id"), ("source", "source")))
    size = options.get("size")
    size = word_count(F.col(text)) if size is None else size
    mixed = stored(mix_sources(docs, **options).where("copies > 0"), "mix-copies")
    taken = mixed.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col("size").alias("n"), "copies")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("doc"), F.col(source).alias("source"),
        size.alias("size"),
    )
    same = rows["doc"].eqNullSafe(taken["k"]) & rows["source"].eqNullSafe(taken["s"]) & (rows["size"] == taken["n"])
    joined = rows.join(taken.hint("shuffle_hash"), same)
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
