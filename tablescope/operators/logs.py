"""Analyses of run logs, error logs, step results and query logs (JSON lines)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.columns import col, seconds
from ..plans.ordered import cut_along, scan, split_points, with_buckets

EVENT_LOG = (
    "ts timestamp, run_id string, event string, agent string, call_number int, model string, input_tokens bigint, output_tokens bigint, "
    "cumulative_input bigint, cumulative_output bigint, message_count int, tool_calls array<string>, response_chars bigint, "
    "step_number int, step string, success boolean, retry_count int, charts int, output_chars bigint, calls bigint, "
    "total_tokens bigint, category string, error string"
)
ERROR_LOG = "timestamp timestamp, context string, type string, message string, traceback string"
RUN_STEPS = (
    "run_id string, step_number int, step string, text_output string, charts int, error string, attempts int, seconds double"
)
QUERY_LOG = "round int, expression string, reason string, result string"


def write_run_log(events: DataFrame, path: str) -> str:
    """Append records as JSON lines."""
    events.write.mode("append").json(path)
    return path


def read_run_log(spark: SparkSession, path: str, schema: str = EVENT_LOG) -> DataFrame:
    """The log with ``_corrupt_record`` set on lines that are not JSON, so that they can be counted."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def malformed_lines(log: DataFrame) -> DataFrame:
    """(lines, events, malformed)"""
    return log.agg(F.count("*").alias("lines"), F.count("event").alias("events"), F.count("_corrupt_record").alias("malformed"))


def log_token_totals(log: DataFrame) -> DataFrame:
    """(agent, calls, input_tokens, output_tokens, total_tokens) per agent; agent is null in the overall row."""
    i, o = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    return log.where("event = 'llm_call'").rollup("agent").agg(
        F.count("*").alias("calls"), F.sum(i).alias("input_tokens"), F.sum(o).alias("output_tokens"), F.sum(i + o).alias("total_tokens")
    )


def log_running_totals(log: DataFrame, tie: str = "call_number") -> DataFrame:
    """(run_id, ts, agent, call, cumulative_input, cumulative_output) after each call of a run, in time order.

    Calls without ``run_id``, or of a log without that column, are one run of their own.  Runs are cut along time (and ``tie`` among equal
    times), so a run with a large part of the log is spread out."""
    run_id = F.col("run_id").cast("string") if "run_id" in log.columns else F.lit(None).cast("string")
    calls = log.where("event = 'llm_call' and ts is not null").select(
        F.coalesce(F.concat(F.lit("="), run_id), F.lit("")).alias("run_id"), "ts", "agent", col(tie), seconds("ts").alias("_t"),
        F.coalesce("input_tokens", F.lit(0)).alias("_i"), F.coalesce("output_tokens", F.lit(0)).alias("_o"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    cut, buckets = cut_along(calls, "_t", tie)
    sums = {"call": "_one", "cumulative_input": "_i", "cumulative_output": "_o"}
    return scan(cut, buckets, ["_t", tie], sums, keys=["run_id"], few_keys=False).select(
        F.when(F.col("run_id") != "", F.substring("run_id", 2, 2**31 - 1)).alias("run_id"), "ts", "agent", "call", "cumulative_input",
        "cumulative_output",
    )


def log_delta_totals(totals: DataFrame, key: str, phases: Sequence[str] = ("pipeline", "chat")) -> DataFrame:
    """(key, phase, calls, input_tokens, output_tokens, total_tokens): what each later phase added, and the merged total.

    ``totals`` has one row per key and counter reading: phase ('pipeline', 'chat' so far, or 'current') and the counters under either
    spelling (input/output or input_tokens/output_tokens).  The addition is current minus the known phases, at least 0."""
    pick = lambda *names: F.coalesce(*[col(n) for n in names if n in totals.columns], F.lit(0))
    even = totals.select(
        col(key), "phase", pick("calls").alias("calls"), pick("input_tokens", "input").alias("input_tokens"),
        pick("output_tokens", "output").alias("output_tokens"),
    )
    names = ("calls", "input_tokens", "output_tokens")
    part = lambda p, n: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col(n))), F.lit(0)).alias(f"{p}_{n}")
    wide = even.groupBy(col(key)).agg(*[part(p, n) for p in (*phases, "current") for n in names])
    known = {n: reduce(lambda a, b: a + b, [F.col(f"{p}_{n}") for p in phases]) for n in names}
    delta = {n: F.greatest(F.lit(0), F.col(f"current_{n}") - known[n]) for n in names}
    last = phases[-1]

    def record(label: str, counters: dict) -> Column:
        return F.struct(
            F.lit(label).alias("phase"), *[counters[n].cast("bigint").alias(n) for n in names],
            (counters["input_tokens"] + counters["output_tokens"]).cast("bigint").alias("total_tokens"),
        )

    rows = [
        record("delta", delta), record(last, {n: F.col(f"{last}_{n}") + delta[n] for n in names}),
        record("total", {n: known[n] + delta[n] for n in names}),
    ]
    return wide.select(col(key), F.inline(F.array(*rows)))


def log_step_stats(log: DataFrame) -> DataFrame:
    """(success, steps, retries, charts, output_chars)"""
    return log.where("event = 'step_executed'").groupBy("success").agg(
        F.count("*").alias("steps"), F.sum("retry_count").cast("bigint").alias("retries"), F.sum("charts").cast("bigint").alias("charts"),
        F.sum("output_chars").alias("output_chars"),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """(type, context, class, n)"""
    kind = X.error_class(F.col("type"), F.coalesce("message", F.lit("")))
    return errors.groupBy("type", "context", kind.alias("class")).agg(F.count("*").alias("n"))


def error_classes(errors: DataFrame) -> DataFrame:
    """The errors with the class of each."""
    return errors.withColumn("class", X.error_class(F.col("type"), F.coalesce("message", F.lit(""))))


def query_log(log: DataFrame) -> DataFrame:
    """(reason, queries, rounds, failed, result_chars): what was asked and how it went."""
    return log.groupBy("reason").agg(
        F.count("*").alias("queries"), F.max("round").cast("bigint").alias("rounds"),
        F.count_if(F.col("result").startswith("ERROR:")).alias("failed"), F.sum(F.length("result")).cast("bigint").alias("result_chars"),
    )


def step_status(steps: DataFrame) -> DataFrame:
    """(total, successful, failed, with_charts, retried)"""
    return steps.agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("charts") > 0).alias("with_charts"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
    )


def step_findings(steps: DataFrame, key: Sequence[str] = ("run_id", "step_number"), chars: int = K.FINDING_CHARS) -> DataFrame:
    """(key…, finding) of the successful steps: the step and the start of its output on one line."""
    out = X.stripped(F.coalesce("text_output", F.lit("")))
    short = F.replace(F.substring(out, 1, chars), F.lit("\n"), F.lit(" "))
    finding = F.concat(F.col("step"), F.lit(": "), F.when(out == "", K.NO_OUTPUT).otherwise(short))
    return steps.where("error is null").select(*[col(k) for k in key], finding.alias("finding"))


def context_pack(
    steps: DataFrame, output_chars: int = K.REPORT_OUTPUT_CHARS, error_chars: int = K.REPORT_ERROR_CHARS, part_steps: int = 500,
    chat: bool = False,
) -> DataFrame:
    """(run_id, part, steps, text): the step results of a run as one text in step order, outputs and errors cut.

    The chat layout has no output label and mentions charts only for a step without output and error.

    Every ``part_steps`` steps start a new part, so a run of any length is packed by many tasks and no cell grows without
    bound; concatenating the parts gives the whole context."""
    out, err = F.coalesce("text_output", F.lit("")), F.coalesce("error", F.lit(""))
    empty = X.stripped(out) == ""
    charted = (empty & (err == "")) if chat else F.coalesce("charts", F.lit(0)) > 0
    label = F.lit("" if chat else K.OUTPUT_LABEL)
    piece = F.concat(
        F.lit(K.STEP_OPEN), F.col("step_number").cast("string"), F.lit(": "), F.col("step"), F.lit(K.STEP_CLOSE),
        F.when(~empty, F.concat(label, F.substring(out, 1, output_chars), F.lit("\n"))).otherwise(""),
        F.when(err != "", F.concat(F.lit(K.ERROR_LABEL), F.substring(err, 1, error_chars), F.lit("\n"))).otherwise(""),
        F.when(charted, K.CHART_MARK).otherwise(""),
    )
    rows = steps.select("run_id", "step_number", piece.alias("_text"), F.lit(1).cast("bigint").alias("_one"))
    cut = with_buckets(rows, split_points(rows, ["step_number"]))
    placed = scan(cut, ["_b_step_number"], ["step_number"], {"_i": "_one"}, keys=["run_id"], few_keys=False)
    numbered = placed.withColumn("part", F.floor((F.col("_i") - 1) / F.lit(part_steps)).cast("bigint"))
    packed = numbered.groupBy("run_id", "part").agg(
        F.count("*").alias("steps"), F.array_sort(F.collect_list(F.struct("step_number", "_text"))).alias("_all")
    )
    return packed.select("run_id", "part", "steps", F.array_join(F.col("_all._text"), "").alias("text"))
