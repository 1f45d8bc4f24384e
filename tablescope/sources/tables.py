"""Reading and writing tables."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col
from .clean import apply_schema, infer_types, normalize_missing


#: The column for records with more cells than their header.
RESCUED = "_rescued"


class EmptyTableError(ValueError):
    """The file has no columns to read."""


class UnknownFormatError(ValueError):
    """No reader accepts the file."""


def _unique(names: Sequence[str | None]) -> list[str]:
    """Header names with repeats numbered (a, a.1) and blanks named by position."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = name if name else f"Unnamed: {i}"
        new, k = base, 0
        while new in out:
            k += 1
            new = f"{base}.{k}"
        out.append(new)
    return out


def _layouts(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> list[tuple[list[str], list[str]]]:
    """(header cells, files) for every different header, in the order of the file names.

    The first line that is not blank is the header of a file.  One scan reads the first block of every file; a header with line breaks
    in quotes needs the reader itself, file by file."""
    if options["multiLine"] == "true":
        files = sorted(spark.read.text(path).inputFiles())
        heads = [(f, spark.read.options(**options, header="false").csv(unquote(f)).limit(1).collect()) for f in files]
        found = [(f, tuple(h[0])) for f, h in heads if h]
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        first = lines.where("block = 0 and trim(value) != ''").withColumn("i", F.monotonically_increasing_id())
        heads = first.groupBy("file").agg(F.min_by("value", "i").alias("line")).collect()
        cells = {r["line"]: tuple(next(csv.reader([r["line"].removeprefix("\ufeff").rstrip("\r")], delimiter=options["sep"]))) for r in heads}
        found = sorted((r["file"], cells[r["line"]]) for r in heads)
    by: dict[tuple, list[str]] = {}
    for file, header in found:
        by.setdefault(header, []).append(unquote(file))
    return [(_unique(header), files) for header, files in by.items()]


def load_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, sep: str = ",", multiline: bool = False, rescue: str = RESCUED
) -> DataFrame:
    """UTF-8 text with a header row in every file; missing-value tokens become null.

    Columns are matched by the names in each file's own header, in the order in which names first appear; a column that a file lacks is
    null there.  A record with more cells than its header is kept whole in the column ``rescue``, so no cell is lost; that column is
    left out where no record has any, and with a schema it is there if the schema names it (``csv_report`` counts in any case).  A
    shorter record ends in nulls.  Without a schema one extra scan finds the column types, so pass one for big files.  ``multiline``
    allows line breaks inside quotes, at the price of one task per file."""
    kept = _records(spark, path, sep, multiline, rescue)
    if schema:
        return apply_schema(normalize_missing(kept), schema)
    cells = [c for c in kept.columns if c != rescue]
    if not kept.where(col(rescue).isNotNull()).head(1):
        return infer_types(normalize_missing(kept.select(*[col(c) for c in cells])))
    # a struct is neither cleaned nor typed
    typed = infer_types(normalize_missing(kept.select(*[col(c) for c in cells], F.struct(col(rescue).alias("record")).alias(rescue))))
    return typed.withColumn(rescue, col(rescue)["record"])


def csv_report(spark: SparkSession, path: str | list[str], sep: str = ",", multiline: bool = False) -> DataFrame:
    """(file, records, surplus): the records of every file, and those with more cells than its header."""
    rows = _records(spark, path, sep, multiline, RESCUED, "_file")
    return rows.groupBy(F.regexp_extract("_file", "([^/]+)$", 1).alias("file")).agg(F.count("*").alias("records"), F.count(RESCUED).alias("surplus"))


def _records(spark: SparkSession, path: str | list[str], sep: str, multiline: bool, rescue: str, file: str | None = None) -> DataFrame:
    """All records as text, the columns of all layouts by name, then ``rescue`` and, if named, the file."""
    options = {"sep": sep, "encoding": "UTF-8", "quote": '"', "escape": '"', "multiLine": str(multiline).lower()}
    layouts = _layouts(spark, path, options)
    if not layouts:
        raise EmptyTableError(f"{path} is empty or has no readable columns")
    names = list(dict.fromkeys(name for header, _ in layouts for name in header))
    parts = []
    for header, files in layouts:
        text = T.StructType([T.StructField(n, T.StringType()) for n in (*header, rescue)])
        reader = spark.read.options(**options, header="true", enforceSchema="true", columnNameOfCorruptRecord=rescue)
        rows = reader.schema(text).csv(path if len(layouts) == 1 else files)
        # Spark marks records of any other length; only those with a cell too many lose one
        wider = ", ".join(f"c{i} string" for i in range(len(header) + 1))
        spare = F.from_csv(col(rescue), wider, options)[f"c{len(header)}"]
        shown = [col(n) if n in header else F.lit(None).cast("string").alias(n) for n in names]
        extra = [col(c) for c in rows.columns if c not in header and c != rescue]
        # the reader counts the cells of a record only where all of them are asked for, so the expression names every column
        every = F.length(F.concat(*[col(n) for n in header])) < 0
        record = F.coalesce(F.when(spare.isNotNull(), col(rescue)), F.when(every, ""))
        names_file = [F.col("_metadata.file_path").alias(file)] if file else []
        parts.append(rows.select(*shown, *extra, record.alias(rescue), *names_file))
    return reduce(DataFrame.unionByName, parts)


def load_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    return load_csv(spark, path, schema, sep="\t")


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Reader by format name or extension; an unknown extension is tried as CSV, then as a workbook."""
    from .workbooks import load_ods, load_workbooks

    ext = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ext == "csv":
        return load_csv(spark, path, schema)
    if ext in ("tsv", "txt"):
        return load_tsv(spark, path, schema)
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext in ("json", "jsonl"):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if ext in ("xlsx", "xlsm"):
        return load_workbooks(spark, path, schema)
    if ext in ("ods", "odf"):
        return load_ods(spark, path, schema)
    if ext in ("xls", "xlsb"):
        raise UnknownFormatError(f"{path}: binary workbooks are not read; save as xlsx")
    try:
        return load_csv(spark, path, schema)
    except Exception as first:
        try:
            return load_workbooks(spark, path, schema)
        except Exception:
            raise UnknownFormatError(f"{path}: neither CSV nor workbook") from first


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> str:
    """Parquet keeps the types; CSV and TSV are written with a header."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        writer.options(header="true", sep="," if fmt == "csv" else "\t", encoding="UTF-8", quote='"', escape='"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


@contextmanager
def reuse_input(df: DataFrame, cols: Sequence[str] | None = None) -> Iterator[DataFrame]:
    """Keep the needed columns cached for one run; lost blocks are recomputed from the source."""
    kept = (df.select(*[col(c) for c in cols]) if cols else df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
