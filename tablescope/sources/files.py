"""Files as rows."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

# Fixed name format of step files: plot_<step>_<sub>.png, or plot_<step>.png when a step has only one.
STEP_FILE = r"plot_(\d+)_([^/]*)\.png$"
SINGLE_FILE = r"plot_(\d+)\.png$"
#: Up to so many chosen files (some hundred bytes each) go to every task, and the contents are not shuffled.
SMALL_CHOICE = 50_000


def _named(files: DataFrame, numbered: str, single: str) -> DataFrame:
    """(path, folder, sha256, step, is_numbered, sub) of the step files among files with path and content."""
    path, sub = F.col("path"), F.regexp_extract("path", numbered, 2)
    many, one = F.regexp_extract(path, numbered, 1), F.regexp_extract(path, single, 1)
    return files.select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.sha2("content", 256).alias("sha256"),
        F.when(many != "", many).when(one != "", one).try_cast("bigint").alias("step"), (many != "").alias("is_numbered"),
        F.when(sub.rlike(r"(^|_)\d+$"), F.regexp_extract(sub, r"(\d+)$", 1).try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("sub"),
    ).where("step is not null")


def _chosen(named: DataFrame) -> DataFrame:
    first = F.min(F.struct("sub", "path"))
    kept = named.groupBy("folder", "step", "is_numbered", "sha256").agg(first.alias("f")).select("folder", "step", "is_numbered", "sha256", "f.*")
    several = named.where("is_numbered").select("folder", "step").distinct()
    return kept.where("is_numbered").unionByName(kept.where("not is_numbered").join(several, ["folder", "step"], "left_anti"))


def dedup_files(files: DataFrame, numbered: str = STEP_FILE, single: str = SINGLE_FILE) -> DataFrame:
    """(step, sub, path, sha256, content_base64): per folder and step the first file of each content in sub-index order.

    ``files`` has path and content; the files of different folders are never compared.  A single file counts only for a step without
    numbered ones.  Only the digest and the name are aggregated (a minimum, combined on the map side); the content is joined back for
    the files kept and encoded behind the join.  For files on disk ``dedup_tree`` moves no content at all."""
    chosen = _chosen(_named(files, numbered, single))
    return chosen.join(files.select("path", "content"), "path").select(
        "step", "sub", "path", "sha256", F.base64("content").alias("content_base64")
    )


def dedup_tree(spark: SparkSession, root: str, pattern: str = "*.png", numbered: str = STEP_FILE, single: str = SINGLE_FILE) -> DataFrame:
    """As ``dedup_files`` for all files below a folder, read in two phases.

    The first phase reads every file for its digest; only digests and names are shuffled, and the choice is written once.  The second
    opens the chosen files alone and looks their step up by path.  Their paths pass through the driver, as the listing of any read does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    chosen = materialize(_chosen(_named(files.select("path", "content"), numbered, single)).select("step", "sub", "path", "sha256"), "chosen-files")
    paths = [unquote(r["path"]) for r in chosen.select("path").toLocalIterator()]
    if not paths:
        return chosen.withColumn("content_base64", F.lit(None).cast("string"))
    again = spark.read.format("binaryFile").load(paths).select("path", F.base64("content").alias("content_base64"))
    return again.join(chosen.hint("broadcast" if len(paths) <= SMALL_CHOICE else "shuffle_hash"), "path").select("step", "sub", "path", "sha256", "content_base64")
