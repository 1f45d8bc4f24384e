"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path


ROWS_PER_FILE = 100_000


def stored(df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """The table, written once and read back: it survives lost executors and later plans start from its files.

    ``rows`` is the most rows it can have, where that is known: a small table is then not cut into one file per shuffle partition.
    ``by``, its last column, gets a folder for each value."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE + 1))
    path = scratch_path(spark, "llm-" + name)
    df.write.partitionBy(*[by] if by else []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """As ``stored``, and the shuffle files behind the table are deleted once it is written, as no later plan reads them.

    With ``rows``, for narrow tables, the finished rows are dealt to files by bytes; the joins below keep all their tasks."""
    conf = df.sparkSession.conf
    before = conf.get(_TIDY)
    conf.set(_TIDY, "true")
    try:
        return stored(df if rows is None else df.hint("rebalance"), name, by=by)
    finally:
        conf.set(_TIDY, before)


def remove(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns beside the whole row in one column ``row``, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in keep], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def total_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
