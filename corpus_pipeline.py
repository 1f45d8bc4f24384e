"""From documents to packed batches: five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm import line_dedup, mixing, packing, quality
from tablescope.llm.ngram_join import keep_one_of_each
from tablescope.llm.scratch import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that policy v1 keeps; null and empty texts have too few words."""
    return quality.filter_quality(docs, quality.POLICIES["v1"])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its shared lines; one that loses lines gets its new text and, if it has the column, its new n_chars."""
    rows = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    columns = [
        F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return rows.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their five-word shingles: the one with the smallest id."""
    return keep_one_of_each(docs, n=5, threshold=(4, 5))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources in code point order weigh 1, 2, 3, repeating."""
    return mixing.mixed_rows(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch, slot and padded length of every document of the mix."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]

#: The mix draws at random and the buckets come from a dynamic programme, so the rows are tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name)
    return STAGES[-1][1](spark, docs, sf_dir)
