"""Lines that many documents share, kept in levelled sorted runs of line hashes.

A run holds one row per line key, in hash order: two 64-bit hashes, the number of documents with it and the largest of their ids, never
a text.  A new batch is merge-anti-joined with what the runs have already settled, the rest becomes a run of its own, and when a level
holds ``fanout`` runs they are merged into one run of the next level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import parallelism, scratch_path
from .scratch import remove, stored
from .texts import SPACE, ascii_lower, let

NO_ID = -(1 << 63)
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _merged(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))


class LineRuns:
    """The runs of one store.  ``min_docs`` is the number of documents that makes a line a shared one."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        return stored(rows.repartition(parallelism(self.spark), *HASH).sortWithinPartitions(*HASH), "line-run")

    def add(self, keys: DataFrame) -> None:
        """Add a batch of rows (doc, h1, h2); batches may come in any order but a document belongs to one batch."""
        batch = keys.select("doc", *HASH).distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("top"))
        if self.levels:
            settled = self.counts().where(F.col("n_docs") >= self.min_docs).withColumnRenamed("top", "known")
            same = [batch[c] == settled[c] for c in HASH]
            batch = batch.join(settled, [*same, batch["top"] <= settled["known"]], "left_anti")
        self._place(self._write(batch), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._write(_merged(old)), level + 1)
            remove(*old)

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, top) over all runs.  ``n_docs`` is exact below ``min_docs`` and a lower bound from there on."""
        return _merged([run for level in self.levels for run in level])

    def shared(self) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= self.min_docs).select(*HASH, "top")


def line_keys(docs: DataFrame, min_chars: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, text_hash, place, h1, h2) of each line whose key has ``min_chars`` code points or more."""
    placed = docs.select(
        F.coalesce(F.col(key), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.transform(_lines(F.col(text)), line_key)).alias("place", "line"),
    )
    kept = placed.where(F.length("line") >= min_chars)
    return kept.select("doc", "text_hash", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _batch_of(docs: DataFrame, key: str, batches: int) -> Column:
    """Ranges of ids, the largest ids first, so that the largest holder of a line is met before the others."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col(key), shares, F.lit(1000)).alias("cuts")).first()["cuts"] or []
    return sum((F.when(F.col("doc") <= cut, 1).otherwise(0) for cut in cuts), F.lit(0))


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, text_hash, places) for each document that loses lines; places count from 0."""
    spark = docs.sparkSession
    keys = line_keys(docs, min_chars, text, key).withColumn("batch", _batch_of(docs, key, batches))
    path = scratch_path(spark, "llm-line-keys")
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch))
    shared = stored(runs.shared(), "shared-lines")
    remove(*[run for level in runs.levels for run in level])
    lost = keys.join(shared, list(HASH)).where(F.col("doc") < F.col("top"))
    return lost.groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places"))


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Each row of ``docs`` as column ``row`` with ``n_lines``, ``n_dropped`` and the text ``kept``.

    A text is split at line feeds; null and empty are one empty line.  A key of ``min_chars`` code points or more that ``min_docs``
    documents or more hold loses all its lines except in the document with the largest id, which keeps all of its own.  Rows that share
    an id are one document; rows without an id are together one document below all others.  A text that loses nothing is kept
    unchanged, null as empty.  An empty table gives an empty table; other columns are left alone whatever their names."""
    lost = shared_lines(docs, min_chars, min_docs, batches, text, key)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(key), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"),
    )
    joined = rows.join(lost.hint("shuffle_hash"), ["doc", "text_hash"], "left")
    body = F.coalesce(F.col("row")[text], F.lit(""))

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return joined.select(
        "row", (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), body).otherwise(let(_lines(F.col("row")[text]), rest)).alias("kept"),
    )
