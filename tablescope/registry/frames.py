"""Derived input frames, each as a Spark expression and as SQL over the same tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

# documents with their labels: quality and toxic are missing for the unlabelled ones
LABELLED_SQL = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
# events with a missing value where the event is an error (NaN in Spark, so that the merge of NaN and null is exercised)
HOLES_SQL = "(SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS seen FROM events)"
CONST_SQL = "(SELECT *, 1 AS const_col, CASE WHEN l_orderkey = 0 THEN 1 ELSE 0 END AS near_const FROM lineitem)"
SIZES_SQL = "(SELECT doc_id, n_chars, length(text) AS text_chars, length(lang) AS lang_chars FROM documents)"
CALLS_SQL = """(SELECT CAST(conv_id AS VARCHAR) AS run_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn * 30) AS ts,
  CASE WHEN role = 'system' THEN 'agent_start' ELSE 'llm_call' END AS event, role AS agent, turn AS call_number,
  length(text) AS input_tokens, length(text) // 4 AS output_tokens FROM conversations)"""
STEPS_SQL = """(SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS step_number, event_type AS step,
  CASE WHEN event_type = 'view' THEN '  ' ELSE ' ' || props || chr(10) || event_type || ' ' END AS text_output,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS charts,
  CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error,
  CASE WHEN value > 100 THEN 3 WHEN value > 50 THEN 2 ELSE 1 END AS attempts FROM events)"""
ERRORS_SQL = """(SELECT CASE event_type WHEN 'error' THEN 'ConnectError' WHEN 'view' THEN 'FileNotFoundError' WHEN 'click' THEN 'EmptyDataError'
    WHEN 'signup' THEN 'AuthenticationError' ELSE 'RuntimeError' END AS type,
  CASE WHEN event_type = 'purchase' AND value > 100 THEN 'Rate LIMIT reached' WHEN event_type = 'purchase' AND value > 50 THEN 'request timed out'
    ELSE props END AS message, CASE WHEN value > 50 THEN 'upload' ELSE 'chat' END AS context FROM events)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def holes(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", seen.alias("seen"))


def constants(spark: SparkSession, sf: str) -> DataFrame:
    near = F.when(F.col("l_orderkey") == 0, 1).otherwise(0)
    return table(spark, sf, "lineitem").select("*", F.lit(1).alias("const_col"), near.alias("near_const"))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.length("text").cast("bigint").alias("text_chars"), F.length("lang").cast("bigint").alias("lang_chars"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """An event log: one model call per conversation turn."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 30).alias("ts"),
        F.when(F.col("role") == "system", "agent_start").otherwise("llm_call").alias("event"), F.col("role").alias("agent"),
        F.col("turn").alias("call_number"), F.length("text").cast("bigint").alias("input_tokens"),
        F.expr("length(text) div 4").alias("output_tokens"),
    )


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Step results: one step per event, users as runs."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("step_number"), kind.alias("step"),
        F.when(kind == "view", "  ").otherwise(F.concat(F.lit(" "), "props", F.lit("\n"), kind, F.lit(" "))).alias("text_output"),
        F.when(kind == "click", 1).otherwise(0).alias("charts"),
        F.when(kind == "error", F.concat(F.lit("failed: "), "props")).alias("error"),
        F.when(value > 100, 3).when(value > 50, 2).otherwise(1).alias("attempts"),
    )


def errors(spark: SparkSession, sf: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    name = (
        F.when(kind == "error", "ConnectError").when(kind == "view", "FileNotFoundError").when(kind == "click", "EmptyDataError")
        .when(kind == "signup", "AuthenticationError").otherwise("RuntimeError")
    )
    message = (
        F.when((kind == "purchase") & (value > 100), "Rate LIMIT reached")
        .when((kind == "purchase") & (value > 50), "request timed out").otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select(
        name.alias("type"), message.alias("message"), F.when(value > 50, "upload").otherwise("chat").alias("context"))


def workbooks(df: DataFrame, part: str, order: str, kind: str = "xlsx") -> DataFrame:
    """(path, content): the rows of a table written as small workbooks, one per value of ``part``."""
    names = [c for c in df.columns if c != part]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        body = [names, *pdf.sort_values(order)[names].astype(object).values.tolist()]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            if kind == "xlsx":
                z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(
                    "<row>" + "".join(
                        f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
                        for v in row) + "</row>" for row in body) + "</sheetData></worksheet>")
            else:
                z.writestr("content.xml", '<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table>' + "".join(
                    "<t:table-row>" + "".join(
                        f'<t:table-cell o:value="{v!r}"/>' if isinstance(v, (int, float)) else f"<t:table-cell><x:p>{escape(str(v))}</x:p></t:table-cell>"
                        for v in row) + "</t:table-row>" for row in body) + "</t:table></d>")
        return pd.DataFrame({"path": [f"{int(pdf[part].iloc[0])}.{kind}"], "content": [buffer.getvalue()]})

    return df.groupBy(part).applyInPandas(build, "path string, content binary")
