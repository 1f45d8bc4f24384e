"""Pack texts in batches of a token budget, in length buckets that waste as little padding as possible.

A histogram of lengths is gathered for the whole table; its size depends on the number of length classes, not on the rows.  A dynamic
programme over the histogram chooses the bucket boundaries with the least padding.  Inside a bucket each batch takes as many texts as
fit the budget when all are padded to the bucket's longest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import parallelism
from .scratch import stored
from .texts import word_count

EXACT = 512


@dataclass(frozen=True)
class Bucket:
    top: int
    rows: int
    tokens: int


def length_class(length: Column) -> Column:
    """Lengths up to EXACT are classes of their own, above each power of two has EXACT / 2 classes: below 0.4 % of a length wide."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT)).cast("double"))) - F.lit(np.log2(EXACT // 2)))
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(longest, rows, tokens) of each length class of a table with a column ``length``, shortest first."""
    rows = lengths.groupBy(length_class(F.col("length")).alias("class")).agg(
        F.max("length").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")
    )
    return sorted((r["top"], r["n"], r["tokens"]) for r in rows.collect())


def best_buckets(classes: list[tuple[int, int, int]], most: int) -> list[Bucket]:
    """At most ``most`` runs of classes with the least total of rows * longest; of equal totals the one with fewer, earlier cuts."""
    if not classes:
        return []
    top, rows, tokens = (np.array(x, dtype=np.int64) for x in zip(*classes))
    n, before = len(top), np.concatenate([[0], np.cumsum(rows)])
    best = top * before[1:]
    cuts = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(most, n)):
        after, cut = best.copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, n):
            total = best[:j] + top[j] * (before[j + 1] - before[1:j + 1])
            i = int(np.argmin(total))
            if total[i] < after[j]:
                after[j], cut[j] = total[i], i + 1
        best = after
        cuts.append(cut)
    ends, j = [], n - 1
    for cut in reversed(cuts):
        ends.append(j)
        if cut[j] == 0 and cut is not cuts[0]:
            continue
        j = int(cut[j]) - 1
        if j < 0:
            break
    ends = sorted(set(ends))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [Bucket(int(top[e]), int(before[e + 1] - before[s]), int(tokens[s:e + 1].sum())) for s, e in zip(starts, ends)]


def pack(docs: DataFrame, budget: int = 16_384, buckets: int = 16, text: str = "text", key: str = "doc_id", length: Column | None = None) -> DataFrame:
    """(key, length, bucket, padded, batch, slot) for each row of ``docs``.

    ``length`` is the number of words, or the given expression; null counts 0.  ``padded`` is the bucket's longest length; a batch holds
    ``budget // padded`` texts, and a text longer than the budget is a batch of its own.  Batches are numbered through all buckets, the
    shortest first; inside a bucket texts are taken in an order that scatters ids and depends on them alone.  Repeated rows are packed
    each, null keys come last, an empty table gives an empty result, further columns are ignored."""
    spark = docs.sparkSession
    length = word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    lengths = stored(docs.select(F.col(key).alias("doc"), length.alias("length")), "pack-lengths")
    chosen = best_buckets(histogram(lengths), buckets)
    bucket, padded, room, first, at = F.lit(0), F.lit(0), F.lit(1), F.lit(0), 0
    for i, b in enumerate(chosen):
        fits = max(1, budget // max(1, b.top))
        here = F.col("bucket") == i
        bucket = bucket + (F.when(F.col("length") > b.top, 1).otherwise(0) if i + 1 < len(chosen) else F.lit(0))
        padded, room, first = F.when(here, b.top).otherwise(padded), F.when(here, fits).otherwise(room), F.when(here, at).otherwise(first)
        at += -(-b.rows // fits)
    order = ("bucket", F.col("scatter").asc_nulls_last(), F.col("doc").asc_nulls_last(), "length", "row_no")
    rows = lengths.withColumns({
        "bucket": bucket, "scatter": F.when(F.col("doc").isNotNull(), F.xxhash64("doc")), "row_no": F.monotonically_increasing_id(),
    })
    pieces = stored(rows.repartitionByRange(parallelism(spark), *order).withColumn("piece", F.spark_partition_id()), "pack-pieces")
    counts = pieces.groupBy("piece", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each piece and bucket in it
    offsets = counts.select("piece", "bucket", (F.sum("n").over(Window.partitionBy("bucket").orderBy("piece")) - F.col("n")).alias("offset"))
    local = F.row_number().over(Window.partitionBy("piece", "bucket").orderBy(*order[1:]))
    ranked = pieces.withColumn("local", local).join(offsets, ["piece", "bucket"])
    rank = F.col("offset") + F.col("local") - 1
    return ranked.select(
        F.col("doc").alias(key), "length", F.col("bucket").cast("int").alias("bucket"), padded.cast("long").alias("padded"),
        (first + F.floor(rank / room)).cast("long").alias("batch"), (rank % room).cast("long").alias("slot"),
    )


def padding(chosen: list[Bucket]) -> int:
    return sum(b.rows * b.top - b.tokens for b in chosen)
