"""Text functions as column expressions; all of them run inside the JVM and take whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from .columns import col

EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def strip_code_fence(text: Column) -> Column:
    """Without a leading fence line, the closing fence line if there is one, and a leading language word."""
    t = stripped(text)
    body = F.regexp_replace(t, "^```[^\n]*\n?", "")
    body = F.regexp_replace(body, "(^|\n)[ \t]*```$", "")
    return F.when(t.startswith("```"), F.regexp_replace(body, "^python\n*", "")).otherwise(t)


def plan_steps(text: Column, fallback: Sequence[str]) -> Column:
    """The JSON array of strings in a model reply (the part between the first two fences, if it is fenced)."""
    t = stripped(text)
    inside = F.when(t.startswith("```"), F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), "^json", "")).otherwise(t)
    whole = F.when(stripped(inside).rlike(r"(?s)^\[.*\]$"), F.from_json(inside, "array<string>", {"allowSingleQuotes": "false"}))
    return F.coalesce(whole, F.array(*[F.lit(s) for s in fallback]))


def parse_plan_json(df: DataFrame, key: str, text: str, fallback: Sequence[str]) -> DataFrame:
    """(key, step_number, step)"""
    steps = df.select(col(key), F.posexplode(plan_steps(col(text), fallback)).alias("step_number", "step"))
    return steps.withColumn("step_number", F.col("step_number") + 1)


ENVELOPE = (
    "struct<output:array<struct<type:string,content:array<struct<text:string>>,call_id:string,name:string,arguments:string>>>"
)


def extract_message_text(reply: Column) -> Column:
    """The first text of the message blocks of a reply (JSON text), else an empty string."""
    blocks = F.filter(F.from_json(reply, ENVELOPE)["output"], lambda b: b["type"] == "message")
    texts = F.filter(F.flatten(F.transform(blocks, lambda b: F.coalesce(b["content"], F.array()))), lambda c: c["text"].isNotNull())
    return F.coalesce(F.get(texts, F.lit(0))["text"], F.lit(""))


def extract_tool_calls(df: DataFrame, key: Sequence[str], reply: str) -> DataFrame:
    """(key…, call_id, name, arguments): one row per function call, the arguments as a map."""
    calls = F.filter(F.from_json(col(reply), ENVELOPE)["output"], lambda b: b["type"] == "function_call")
    rows = df.select(*[col(k) for k in key], F.explode(calls).alias("call"))
    return rows.select(
        *[col(k) for k in key], "call.call_id", "call.name", F.from_json("call.arguments", "map<string,string>").alias("arguments")
    )


def clean_markdown(text: Column) -> Column:
    """Without bold, italic, heading and code marks, with &, < and > escaped."""
    t = F.regexp_replace(text, r"(?d)\*\*(.*?)\*\*", "$1")
    t = F.regexp_replace(t, r"(?d)\*(.*?)\*", "$1")
    t = F.regexp_replace(t, r"#+\s*", "")
    t = F.regexp_replace(t, r"(?d)`(.*?)`", "$1")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(mark), F.lit(entity))
    return stripped(t)


def split_report_lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key…, line, kind, text): report lines as empty, h2, h1, bullet or body."""
    # stripped inside the array, so that the branches below do not each repeat it
    lines = df.select(*[col(k) for k in key], F.posexplode(F.transform(F.split(col(text), "\n"), stripped)).alias("line", "raw"))
    raw = F.col("raw")
    bullet = raw.startswith("- ") | raw.startswith("* ")
    kind = (
        F.when(raw == "", "empty").when(raw.startswith("## "), "h2").when(raw.startswith("# "), "h1")
        .when(bullet, "bullet").otherwise("body")
    )
    shown = (
        F.when(raw.startswith("## "), F.substr(raw, F.lit(4))).when(raw.startswith("# "), F.substr(raw, F.lit(3)))
        .otherwise(clean_markdown(F.when(bullet, F.concat(F.lit("• "), F.substr(raw, F.lit(3)))).otherwise(raw)))
    )
    return lines.select(*[col(k) for k in key], "line", kind.alias("kind"), shown.alias("text"))


def truncate_text(text: Column, n: int = K.QUERY_TEXT_CHARS, note: bool = True) -> Column:
    """At most n characters; a cut text says how long it was."""
    cut = F.substring(text, 1, n)
    if note:
        cut = F.concat(cut, F.lit(K.CUT_OPEN), F.length(text).cast("string"), F.lit(K.CUT_CLOSE))
    return F.when(F.length(text) > n, cut).otherwise(text)


def tail_text(text: Column, n: int = 600) -> Column:
    return F.right(stripped(text), F.lit(n))


def first_lines(text: Column, n: int = 60) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def format_count(number: Column) -> Column:
    return F.format_number(number, 0)


def file_extension(name: Column) -> Column:
    """The part after the last dot in upper case (the whole name if there is no dot)."""
    return F.upper(F.element_at(F.split(name, r"\."), -1))


ERROR_CLASSES = ("auth", "timeout", "rate_limit", "missing_file", "empty_file", "connection", "other")


def error_class(kind: Column, message: Column) -> Column:
    """First matching class for an exception type name and its message."""
    name, text = F.lower(kind), F.lower(message)
    return (
        F.when(name.contains("authentication") | text.contains("api_key"), "auth")
        .when(text.contains("timeout") | text.contains("timed out"), "timeout")
        .when(text.contains("rate") & text.contains("limit"), "rate_limit")
        .when(kind == "FileNotFoundError", "missing_file")
        .when(name.contains("emptydata") | text.contains("no columns"), "empty_file")
        .when(text.contains("connection") | name.contains("connect"), "connection")
        .otherwise("other")
    )
