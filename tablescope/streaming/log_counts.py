"""Token totals of a growing log directory as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.logs import EVENT_LOG
from ..session import scratch_path


def windowed_calls(log: DataFrame, width: str) -> DataFrame:
    """(start, agent, calls, input_tokens, output_tokens) per tumbling window of a table of events."""
    sums = log.where("event = 'llm_call'").groupBy(F.window("ts", width), "agent").agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "agent", "calls", "input_tokens", "output_tokens")


def stream_log_counts(
    spark: SparkSession, path: str, width: str = "1 hour", out: str | None = None, files_per_batch: int = 1_000, timeout: int | None = None,
    every: int = 64,
) -> DataFrame:
    """Process what is in a JSON-lines log directory and return the windowed totals, the same as of one batch over all files.

    The totals are sums, so each micro-batch writes its own below ``out`` and reading adds them up: no state is held and no record is
    too late, however old.  A batch that is replayed overwrites its own folder, so the result is exact after a failure.  After ``every``
    batches their sums become one generation (``compact``), so reading never opens more than ``every`` batches.  Calling again
    with the same ``out`` and ``width`` goes on from there.  ``timeout`` in seconds ends a call that may not take longer."""
    out = out or scratch_path(spark, "log-counts")
    log = spark.readStream.schema(EVENT_LOG).option("maxFilesPerTrigger", files_per_batch).json(path)

    def save(batch: DataFrame, number: int) -> None:
        windowed_calls(batch, width).write.mode("overwrite").parquet(f"{out}/batches/b={number}")
        if (number + 1) % every == 0:
            compact(spark, out, number)

    query = (
        log.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    try:
        if query.awaitTermination(timeout) is False:
            raise TimeoutError("the stream did not finish in time; call again to continue")
    finally:
        query.stop()
    return total_counts(spark, out)


def _numbered(spark: SparkSession, folder: str, prefix: str, done: bool = False) -> list[int]:
    """The numbers of the folders ``<prefix><number>``; with ``done`` only of those whose write has ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [(f.getPath(), f.getPath().getName()) for f in fs.listStatus(path)]
    marked = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(name[len(prefix):]) for p, name in found if name.startswith(prefix) and (not done or fs.exists(marked(p, "_SUCCESS"))))


def _current(spark: SparkSession, out: str) -> tuple[int, list[int]]:
    """The last batch in the newest whole generation, -1 without one, and the batches after it."""
    upto = max(_numbered(spark, f"{out}/generations", "upto=", done=True), default=-1)
    return upto, [b for b in _numbered(spark, f"{out}/batches", "b=") if b > upto]


def compact(spark: SparkSession, out: str, number: int) -> None:
    """Make the sums of all batches up to ``number`` one generation, and delete what it replaces.

    A generation counts once Spark has marked its folder as written, so a failure before that leaves the old one in force, and
    one after it leaves folders that are not read and go with the next generation.  A replayed batch that is already in a
    generation is not read either."""
    upto, _ = _current(spark, out)
    if upto < number:
        total_counts(spark, out).write.mode("overwrite").parquet(f"{out}/generations/upto={number}")
    upto, _ = _current(spark, out)
    old = [f"{out}/batches/b={b}" for b in _numbered(spark, f"{out}/batches", "b=") if b <= upto]
    old += [f"{out}/generations/upto={g}" for g in _numbered(spark, f"{out}/generations", "upto=") if g < upto]
    for folder in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    """(start, agent, calls, input_tokens, output_tokens) from the newest generation and the batches written since."""
    upto, batches = _current(spark, out)
    folders = [f"{out}/batches/b={b}" for b in batches] + ([f"{out}/generations/upto={upto}"] if upto >= 0 else [])
    sums = ("calls", "input_tokens", "output_tokens")
    kinds = "start timestamp_ntz, agent string, calls bigint, input_tokens bigint, output_tokens bigint"
    rows = spark.read.schema(kinds).parquet(*folders) if folders else spark.createDataFrame([], kinds)
    return rows.groupBy("start", "agent").agg(*[F.sum(c).alias(c) for c in sums])
