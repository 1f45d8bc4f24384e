"""Source, query, log, report and text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import CHAT_ERROR_CHARS, CHAT_OUTPUT_CHARS
from ..functions import text as X
from ..operators import logs as G, query as Q, report as R
from ..session import scratch_path
from ..sources import clean as N, files as P, tables as S, workbooks as B
from ..streaming.log_counts import stream_log_counts
from . import frames as FR
from .analysis import _corr, _fences, _kruskal
from .common import Entry, on, r, rounded, table, union_all
from .profile import LABELLED, LINE, _nulls

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderdate, o_orderpriority FROM orders"
PART = "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 2) AS p_retailprice FROM part"


def _written(spark, sf: str, name: str, fmt: str) -> str:
    return S.write_table(table(spark, sf, name), f"{scratch_path(spark, name)}.{fmt}", fmt)


def _layouts(spark, sf: str) -> str:
    """orders in files of three layouts: key and customer, status and key, key and status with a cell more than the header."""
    path, third = f"{scratch_path(spark, 'layouts')}.csv", F.col("o_orderkey") % 3
    orders = table(spark, sf, "orders")
    for i, cols in enumerate((("o_orderkey", "o_custkey"), ("o_orderstatus", "o_orderkey"))):
        orders.where(third == i).select(*cols).write.mode("append").options(header="true").csv(path)
    rest = orders.where(third == 2).select(F.concat_ws(",", "o_orderkey", "o_orderstatus", F.concat(F.lit("more "), "o_custkey")).alias("o_orderkey,o_orderstatus"))
    rest.write.mode("append").options(header="true", quote="", escapeQuotes="false").option("sep", "\t").csv(path)
    return path


def _log(spark, sf: str) -> DataFrame:
    """The event log written as JSON lines, with a broken line per system turn, and read back."""
    path = scratch_path(spark, "log")
    calls = FR.calls(spark, sf)
    G.write_run_log(calls.where("event = 'llm_call'"), path)
    G.write_run_log(calls.where("event <> 'llm_call'"), path)
    broken = table(spark, sf, "conversations").where("role = 'system'").select(F.concat(F.lit("{not json "), "turn").alias("value"))
    broken.write.mode("append").text(path)
    return G.read_run_log(spark, path)


def _stream(spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-log")
    G.write_run_log(FR.calls(spark, sf), path)
    return stream_log_counts(spark, path, "1 hour", files_per_batch=2)


def _dirty(spark, sf: str) -> DataFrame:
    """orders as text: status F as 'NA', totals of status O as no number, dates of status P in another format."""
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(status == "F", "NA").when(status == "O", "").otherwise(status).alias("status"),
        F.when(status == "O", "n.n.").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("total"),
        F.when(status == "P", F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("day"),
    )


STATUS = "CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE o_orderstatus END AS status"
DIRTY_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'NA' WHEN 'O' THEN '' ELSE o_orderstatus END AS status"


def _files(spark, sf: str) -> DataFrame:
    """documents as files: the source number as step, plus one single file per step and document language."""
    docs = table(spark, sf, "documents")
    step, content = F.substr("source", F.lit(4)), F.col("text").cast("binary").alias("content")
    numbered = F.concat(F.lit("out/plot_"), step, F.lit("_"), "doc_id", F.lit(".png"))
    single = F.concat(F.lit("out/plot_"), (F.lit(1000) + F.col("doc_id")).cast("string"), F.lit(".png"))
    return docs.select(F.when(F.col("lang") == "de", single).otherwise(numbered).alias("path"), content)


def _workbook(spark, sf: str, kind: str, name: str, key: str, order: str) -> DataFrame:
    rows = table(spark, sf, name)
    if name == "orders":
        rows = rows.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    files = FR.workbooks(rows.withColumn("_part", F.floor(F.col(key) / 500)), "_part", order, kind)
    return B.workbook_table(B.parse_workbooks(files, B.xlsx_rows if kind == "xlsx" else B.ods_rows))


FENCED_SQL = """(SELECT doc_id, CASE lang WHEN 'en' THEN '  ```python' || chr(10) || text || chr(10) || '```  ' WHEN 'de' THEN '```' || chr(10) || text
  WHEN 'fr' THEN '```json' || chr(10) || text || chr(10) || '``` ' ELSE text END AS raw FROM documents)"""


def _fenced(spark, sf: str) -> DataFrame:
    lang, text, nl = F.col("lang"), F.col("text"), F.lit("\n")
    raw = (
        F.when(lang == "en", F.concat(F.lit("  ```python"), nl, text, nl, F.lit("```  "))).when(lang == "de", F.concat(F.lit("```"), nl, text))
        .when(lang == "fr", F.concat(F.lit("```json"), nl, text, nl, F.lit("``` "))).otherwise(text)
    )
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


FALLBACK = ("overview", "duplicates")


def _plans(spark, sf: str) -> DataFrame:
    """A model reply per document: a fenced JSON array, a bare one, or text that is no JSON."""
    array = F.to_json(F.array("lang", "source", F.col("n_chars").cast("string")))
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(F.col("lang") == "fr", array)
        .otherwise(F.concat(F.lit("["), "source"))
    )
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


def _replies(spark, sf: str) -> DataFrame:
    """Response envelopes: assistants answer with a message, users with a call, system turns with nothing."""
    nothing = F.lit(None).cast("string")
    message = F.struct(
        F.lit("message").alias("type"), F.array(F.struct(F.col("text").alias("text"))).alias("content"), nothing.alias("call_id"),
        nothing.alias("name"), nothing.alias("arguments"))
    arguments = F.to_json(F.struct(F.col("text").alias("expression"), F.col("role").alias("reason")))
    call = F.struct(
        F.lit("function_call").alias("type"), F.lit(None).cast("array<struct<text:string>>").alias("content"),
        F.concat("conv_id", F.lit("-"), "turn").alias("call_id"), F.lit("query_table").alias("name"), arguments.alias("arguments"))
    blocks = F.when(F.col("role") == "assistant", F.array(message)).when(F.col("role") == "user", F.array(call, message)).otherwise(
        F.filter(F.array(message), lambda b: F.lit(False)))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(blocks.alias("output"))).alias("reply"))


CLEAN = strip(
    r"""replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'),
  '#+\s*', '', 'g'), '`(.*?)`', '\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')""".replace("{}", "{{}}")).replace("{{}}", "{}")


def clean(x: str) -> str:
    return CLEAN.replace("{}", x)


PACK = """chr(10) || '--- Step ' || step_number || ': ' || step || ' ---' || chr(10)
  || CASE WHEN trim(text_output, ' ' || chr(10)) <> '' THEN 'Output:' || chr(10) || left(text_output, {o}) || chr(10) ELSE '' END
  || CASE WHEN error IS NOT NULL THEN 'Error: ' || left(error, {e}) || chr(10) ELSE '' END
  || CASE WHEN charts > 0 THEN '[Visualisation generated]' || chr(10) ELSE '' END"""
CHAT_PACK = """chr(10) || '--- Step ' || step_number || ': ' || step || ' ---' || chr(10)
  || CASE WHEN trim(text_output, ' ' || chr(10)) <> '' THEN left(text_output, 800) || chr(10) ELSE '' END
  || CASE WHEN error IS NOT NULL THEN 'Error: ' || left(error, 300) || chr(10) ELSE '' END
  || CASE WHEN error IS NULL AND trim(text_output, ' ' || chr(10)) = '' THEN '[Visualisation generated]' || chr(10) ELSE '' END"""
CALL_SUMS = "count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"


def _counters(spark, sf: str) -> DataFrame:
    """Counter readings per conversation: users are the pipeline, assistants the chat so far, all turns together the current reading."""
    calls = FR.calls(spark, sf)
    role = F.when(F.col("agent") == "user", "pipeline").when(F.col("agent") == "assistant", "chat").otherwise("current")
    sums = [F.count("*").alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output_tokens")]
    known = calls.groupBy("run_id", role.alias("phase")).agg(*sums).where("phase <> 'current'")
    return known.unionByName(calls.groupBy("run_id").agg(*sums).withColumn("phase", F.lit("current")))


PHASES_SQL = f"""(SELECT run_id, count(*) FILTER (agent = 'user') AS pc, count(*) FILTER (agent = 'assistant') AS cc, count(*) AS tc,
  coalesce(sum(input_tokens) FILTER (agent = 'user'), 0) AS pi, coalesce(sum(input_tokens) FILTER (agent = 'assistant'), 0) AS ci, sum(input_tokens) AS ti,
  coalesce(sum(output_tokens) FILTER (agent = 'user'), 0) AS po, coalesce(sum(output_tokens) FILTER (agent = 'assistant'), 0) AS co, sum(output_tokens) AS tt
  FROM {FR.CALLS_SQL} GROUP BY run_id)"""


def _delta(label: str, calls: str, i: str, o: str) -> str:
    return f"""SELECT run_id, '{label}' AS phase, CAST({calls} AS BIGINT) AS calls, CAST({i} AS BIGINT) AS input_tokens, CAST({o} AS BIGINT) AS output_tokens,
      CAST({i} + {o} AS BIGINT) AS total_tokens FROM {PHASES_SQL}"""


def _query_records(spark, sf: str) -> DataFrame:
    result = F.when(F.col("role") == "system", F.concat(F.lit("ERROR: "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        F.col("turn").cast("int").alias("round"), F.col("text").alias("expression"), F.col("role").alias("reason"), result.alias("result"))


def _suggested(spark, sf: str) -> DataFrame:
    answers = Q.suggested_answers(table(spark, sf, "events").drop("props"))
    parts = [f.select(F.lit(k).alias("question"), F.to_json(F.struct(*f.columns)).alias("answer")) for k, f in answers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _profile(spark, sf: str) -> DataFrame:
    return R.run_profile(table(spark, sf, "orders"), scratch_path(spark, "profile")).steps.drop("run_id", "seconds", "text_output")


ORDER_STEPS = (
    "dataset_shape", "column_overview", "describe_all", "duplicate_row_count", "duplicate_rows", "missing_ranking", "constant_columns", "id_like_columns",
    "numeric_describe", "shape_flags", "histogram", "boxplot_stats", "normality_test", "missing_heatmap", "outlier_ranking", "zscore_row_flags", "isolation_forest",
    "log_candidates", "corr_matrix", "corr_significance", "correlation_choice", "strong_pairs", "scatter_grid", "value_counts", "cardinality_class",
    "category_missing", "all_group_stats", "all_group_tests", *[f"{name}_o_orderdate" for name in (
        "date_range", "counts_by_year", "counts_by_month", "counts_by_weekday", "gap_stats", "trend_lines", "rolling_trend", "time_trend")],
    "encoding_advice", "feature_advice", "quality_issues", "key_findings",
)


def _report(spark, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    steps = [s for s in R.default_steps(orders) if s[0] in ("column_overview", "numeric_describe", "value_counts")]
    path = scratch_path(spark, "report")
    profile = R.run_profile(orders, f"{path}/results", steps)
    R.write_report(profile, R.insights(orders), path)
    return spark.read.text(f"{path}/markdown").select(F.length("value").alias("chars"), F.size(F.split("value", "\n")).alias("lines"))


ISSUES_SQL = f"""SELECT "column", CASE WHEN null_share > 0.2 THEN 'high_missing' ELSE 'missing' END AS issue, nulls AS n FROM ({_nulls(FR.LABELLED_SQL, [c for c, _ in LABELLED])})
  WHERE nulls > 0 UNION ALL SELECT "column", CASE WHEN u <= 1 THEN 'constant' ELSE 'near_constant' END, u FROM ({union_all(
      f'''SELECT '{c}' AS "column", count(*) AS u, max(k) / sum(k) AS s FROM (SELECT {c}, count(*) AS k FROM {FR.LABELLED_SQL} WHERE {c} IS NOT NULL GROUP BY {c})'''
      for c, _ in LABELLED)}) WHERE u <= 1 OR s >= 0.99
  UNION ALL SELECT "column", 'outliers', n_iqr FROM ({_fences(FR.LABELLED_SQL, ('doc_id', 'n_chars', 'quality', 'toxic'))}) WHERE n_iqr > 0"""

SUMMARY_SQL = union_all(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls, 0.0::DOUBLE AS null_share, count(DISTINCT {c}) AS uniques,
    {f"CAST(min({c}) AS TIMESTAMP)" if t == 'timestamp_ntz' else f"round(min({c})::DOUBLE, 4)" if t != 'string' else 'NULL'}::VARCHAR AS lo,
    {f"CAST(max({c}) AS TIMESTAMP)" if t == 'timestamp_ntz' else f"round(max({c})::DOUBLE, 4)" if t != 'string' else 'NULL'}::VARCHAR AS hi,
    {r(f'skewness({c})') if t not in ('string', 'timestamp_ntz') else 'NULL::DOUBLE'} AS skew,
    CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN count(DISTINCT {c}) = count(*) THEN 'unique per row' ELSE '' END AS notes
    FROM lineitem""" for c, t in LINE)

EVENT_NUMBERS = ("event_id", "user_id", "value")
FINDINGS_SQL = f"""SELECT CAST(row_number() OVER (ORDER BY severity DESC, kind, subject) AS INTEGER) AS rank, kind, subject, {r('value')} AS value, {r('severity')} AS severity FROM (
  {union_all(f"SELECT 'skew' AS kind, '{c}' AS subject, skewness({c}) AS value, least(1.0, abs(skewness({c})) / 10) AS severity FROM events HAVING abs(skewness({c})) > 1" for c in EVENT_NUMBERS)}
  UNION ALL SELECT 'outliers', "column", n_iqr::DOUBLE, n_iqr / (SELECT count(*) FROM events) FROM ({_fences('events', EVENT_NUMBERS)}) WHERE n_iqr > 0
  UNION ALL SELECT 'correlation', col_a || ' / ' || col_b, r, abs(r) FROM ({_corr('events', EVENT_NUMBERS, False)}) WHERE abs(r) > 0.7
  UNION ALL {union_all(f"SELECT 'time_trend', '{c} / ts', regr_slope({c}, x), regr_r2({c}, x) FROM (SELECT *, epoch_us(ts) / 86400000000 AS x FROM events) HAVING regr_r2({c}, x) > 0.5" for c in EVENT_NUMBERS)}
  UNION ALL SELECT 'group_difference', 'value / event_type', h, 1 - exp(-h / 2) * (1 + h / 2) FROM ({_kruskal('events', 'event_type', 'value')}) WHERE exp(-h / 2) * (1 + h / 2) < 0.05
  ) QUALIFY row_number() OVER (ORDER BY severity DESC, kind, subject) <= 5"""

QUERIES: dict[str, Entry] = {
    # sources
    "load_csv": (lambda s, d: rounded(S.load_csv(s, _written(s, d, "orders", "csv")), 2), ORDERS),
    "load_csv_layouts": (lambda s, d: rounded(S.load_csv(s, _layouts(s, d)), 2), f"""
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey || ',' || o_orderstatus || ',more ' || o_custkey END AS _rescued FROM orders"""),
    "datetime_report": (lambda s, d: N.datetime_report(_dirty(s, d).withColumn("day", F.when(F.col("o_orderkey") % 7 == 0, "some day").otherwise(F.col("day"))), ["day"]),
                        "SELECT 'day' AS \"column\", count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS lost FROM orders"),
    "load_tsv": (lambda s, d: rounded(S.load_tsv(s, _written(s, d, "part", "tsv")), 2), PART),
    "load_table": (lambda s, d: rounded(S.load_table(s, _written(s, d, "part", "csv")).unionByName(
        S.load_table(s, _written(s, d, "part", "json"))), 2), f"{PART} UNION ALL {PART}"),
    "load_workbooks": (lambda s, d: rounded(_workbook(s, d, "xlsx", "orders", "o_orderkey", "o_orderkey"), 2), ORDERS),
    "load_ods": (lambda s, d: rounded(_workbook(s, d, "ods", "part", "p_partkey", "p_partkey"), 2), PART),
    "write_table": (lambda s, d: rounded(s.read.parquet(_written(s, d, "lineitem", "parquet"))), "SELECT * REPLACE (" + ", ".join(
        f"{r(c)} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ") FROM lineitem"),
    "preview": (on("orders", lambda d: R.overview.preview(d, ["o_orderkey"]), 2), ORDERS + " ORDER BY o_orderkey LIMIT 8"),
    "normalize_missing": (lambda s, d: N.normalize_missing(_dirty(s, d)).select("o_orderkey", "status"), f"SELECT o_orderkey, {STATUS} FROM orders"),
    "coerce_numeric": (lambda s, d: rounded(N.coerce_numeric(_dirty(s, d).select("o_orderkey", "total"), ["total"]), 2),
                       "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice, 2) END AS total FROM orders"),
    "coercion_report": (lambda s, d: N.coercion_report(_dirty(s, d), ["total"]),
                        "SELECT 'total' AS \"column\", count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS coerced FROM orders"),
    "parse_datetimes": (lambda s, d: N.parse_datetimes(_dirty(s, d).drop("total")), f"SELECT o_orderkey, {DIRTY_STATUS}, o_orderdate AS day FROM orders"),
    "dedup_files": (lambda s, d: P.dedup_files(_files(s, d)).select("step", "sub", "sha256", F.length(F.unbase64("content_base64")).alias("bytes")), """
      WITH f AS (SELECT CASE WHEN lang = 'de' THEN 1000 + doc_id ELSE substr(source, 4)::BIGINT END AS step, CASE WHEN lang = 'de' THEN 0 ELSE doc_id END AS sub,
        sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents)
      SELECT step, sub, sha256, bytes FROM (SELECT *, row_number() OVER (PARTITION BY step, sha256 ORDER BY sub) AS k FROM f) WHERE k = 1"""),
    "write_run_log": (lambda s, d: G.malformed_lines(_log(s, d)), "SELECT count(*) + count(*) FILTER (role = 'system') AS lines, count(*) AS events, count(*) FILTER (role = 'system') AS malformed FROM conversations"),
    "read_run_log": (lambda s, d: _log(s, d).where("_corrupt_record is null").select(
        "run_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event", "agent", F.col("call_number").cast("bigint").alias("call_number"), "input_tokens", "output_tokens"),
        f"SELECT run_id, ts, event, agent, call_number, input_tokens, output_tokens FROM {FR.CALLS_SQL}"),
    "reuse_input": (lambda s, d: _reused(s, d), "SELECT count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem"),
    # ad-hoc queries
    "query_table": (on("lineitem", lambda d: Q.query_table(d, "WITH t AS (SELECT l_returnflag, l_quantity FROM df WHERE l_discount > 0.05) SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total FROM t GROUP BY l_returnflag")),
                    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_discount > 0.05 GROUP BY 1"),
    "filter_rows": (on("orders", lambda d: Q.filter_rows(d, "o_totalprice > 400000 AND o_orderstatus = 'F'"), 2), ORDERS + " WHERE o_totalprice > 400000 AND o_orderstatus = 'F'"),
    "lookup_value": (on("orders", lambda d: Q.lookup_value(d, "o_custkey", 77), 2), ORDERS + " WHERE o_custkey = 77"),
    "aggregate_by": (on("lineitem", lambda d: Q.aggregate_by(d, ["l_returnflag", "l_linestatus"], {
        "sum_qty": "sum(l_quantity)", "revenue": "sum(l_extendedprice * (1 - l_discount))", "avg_disc": "avg(l_discount)", "count_order": "count(*)"},
        "l_shipdate <= timestamp_ntz'1998-09-02'"), 3), f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, {r('sum(l_extendedprice * (1 - l_discount))', 3)} AS revenue,
        {r('avg(l_discount)', 3)} AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""),
    "top_k": (on("orders", lambda d: Q.top_k(d, "o_totalprice", 10, ["o_orderkey"]), 2), ORDERS + " ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10"),
    "distinct_values": (on("part", lambda d: Q.distinct_values(d, "p_brand")), "SELECT DISTINCT p_brand FROM part"),
    "query_log": (lambda s, d: G.query_log(_query_records(s, d)), """SELECT role AS reason, count(*) AS queries, max(turn) AS rounds, count(*) FILTER (role = 'system') AS failed,
      CAST(sum(length(text) + CASE WHEN role = 'system' THEN 7 ELSE 0 END) AS BIGINT) AS result_chars FROM conversations GROUP BY role"""),
    "suggested_answers": (_suggested, None),
    "sample_rows": (on("orders", lambda d: Q.sample_rows(d, ["o_orderkey"], 100)), None),
    # report
    "run_profile": (_profile, "SELECT CAST(i AS INTEGER) AS step_number, step, CAST(0 AS INTEGER) AS charts, CAST(NULL AS VARCHAR) AS error, CAST(1 AS INTEGER) AS attempts FROM (VALUES "
                    + ", ".join(f"({i}, '{name}')" for i, name in enumerate(ORDER_STEPS, 1)) + ") v(i, step)"),
    "write_report": (_report, None),
    "quality_issues": (lambda s, d: rounded(R.quality_issues(FR.labelled(s, d))), f"SELECT \"column\", issue, n, {r('n / (SELECT count(*) FROM documents)')} AS share FROM ({ISSUES_SQL})"),
    "key_findings": (on("events", lambda d: R.key_findings(d, 5, [("event_type", "value")])), FINDINGS_SQL),
    "column_summary": (on("lineitem", R.column_summary), SUMMARY_SQL),
    "insights": (on("lineitem", R.insights), None),
    # logs
    "step_status": (lambda s, d: G.step_status(FR.steps(s, d)), f"""SELECT count(*) AS total, count(*) - count(error) AS successful, count(error) AS failed,
      count(*) FILTER (charts > 0) AS with_charts, count(*) FILTER (attempts > 1) AS retried FROM {FR.STEPS_SQL}"""),
    "step_findings": (lambda s, d: G.step_findings(FR.steps(s, d)), f"""SELECT run_id, step_number, step || ': ' || CASE WHEN trim(text_output, ' ' || chr(10)) = '' THEN 'completed successfully.'
      ELSE replace(left(trim(text_output, ' ' || chr(10)), 300), chr(10), ' ') END AS finding FROM {FR.STEPS_SQL} WHERE error IS NULL"""),
    "context_pack": (lambda s, d: G.context_pack(FR.steps(s, d), part_steps=20), f"""SELECT run_id, (i - 1) // 20 AS part, count(*) AS steps, string_agg(t, '' ORDER BY step_number) AS text FROM
      (SELECT run_id, step_number, row_number() OVER (PARTITION BY run_id ORDER BY step_number) AS i, {PACK.format(o=1500, e=300)} AS t FROM {FR.STEPS_SQL}) GROUP BY ALL"""),
    "context_pack_chat": (lambda s, d: G.context_pack(FR.steps(s, d), CHAT_OUTPUT_CHARS, CHAT_ERROR_CHARS, chat=True), f"""SELECT run_id, CAST(0 AS BIGINT) AS part, count(*) AS steps, string_agg(t, '' ORDER BY step_number) AS text FROM
      (SELECT run_id, step_number, {CHAT_PACK} AS t FROM {FR.STEPS_SQL}) GROUP BY ALL"""),
    "log_token_totals": (lambda s, d: G.log_token_totals(FR.calls(s, d)), f"""SELECT agent, {CALL_SUMS}, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM {FR.CALLS_SQL}
      WHERE event = 'llm_call' GROUP BY ROLLUP (agent)"""),
    "log_running_totals": (lambda s, d: G.log_running_totals(FR.calls(s, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz")), f"""SELECT run_id, ts, agent, row_number() OVER w AS call,
      CAST(sum(input_tokens) OVER w AS BIGINT) AS cumulative_input, CAST(sum(output_tokens) OVER w AS BIGINT) AS cumulative_output FROM {FR.CALLS_SQL} WHERE event = 'llm_call'
      WINDOW w AS (PARTITION BY run_id ORDER BY ts, call_number ROWS UNBOUNDED PRECEDING)"""),
    "log_delta_totals": (lambda s, d: G.log_delta_totals(_counters(s, d), "run_id"), union_all([
        _delta("delta", "greatest(0, tc - pc - cc)", "greatest(0, ti - pi - ci)", "greatest(0, tt - po - co)"),
        _delta("chat", "cc + greatest(0, tc - pc - cc)", "(ci + greatest(0, ti - pi - ci))", "(co + greatest(0, tt - po - co))"),
        _delta("total", "pc + cc + greatest(0, tc - pc - cc)", "(pi + ci + greatest(0, ti - pi - ci))", "(po + co + greatest(0, tt - po - co))")])),
    "log_step_stats": (lambda s, d: G.log_step_stats(FR.steps(s, d).select(
        F.lit("step_executed").alias("event"), F.col("error").isNull().alias("success"), (F.col("attempts") - 1).alias("retry_count"), "charts",
        F.length("text_output").cast("bigint").alias("output_chars"))), f"""SELECT error IS NULL AS success, count(*) AS steps, CAST(sum(attempts - 1) AS BIGINT) AS retries,
        CAST(sum(charts) AS BIGINT) AS charts, CAST(sum(length(text_output)) AS BIGINT) AS output_chars FROM {FR.STEPS_SQL} GROUP BY 1"""),
    "error_class": (lambda s, d: G.error_classes(FR.errors(s, d)).groupBy("class").agg(F.count("*").alias("n")), f"""SELECT CASE WHEN type = 'AuthenticationError' THEN 'auth'
      WHEN message LIKE '%timed out%' THEN 'timeout' WHEN message LIKE 'Rate%' THEN 'rate_limit' WHEN type = 'FileNotFoundError' THEN 'missing_file' WHEN type = 'EmptyDataError' THEN 'empty_file'
      WHEN type = 'ConnectError' THEN 'connection' ELSE 'other' END AS class, count(*) AS n FROM {FR.ERRORS_SQL} GROUP BY 1"""),
    "error_counts": (lambda s, d: G.error_counts(FR.errors(s, d)).groupBy("type", "context").agg(F.sum("n").alias("n")),
                     f"SELECT type, context, count(*) AS n FROM {FR.ERRORS_SQL} GROUP BY ALL"),
    "stream_log_counts": (_stream, f"SELECT date_trunc('hour', ts) AS start, agent, {CALL_SUMS} FROM {FR.CALLS_SQL} WHERE event = 'llm_call' GROUP BY ALL"),
    # text
    "strip_code_fence": (lambda s, d: _fenced(s, d).select("doc_id", X.strip_code_fence(F.col("raw")).alias("code")), rf"""SELECT doc_id, CASE WHEN {strip('raw')} LIKE '```%' THEN
      regexp_replace(regexp_replace(regexp_replace({strip('raw')}, '^```[^\n]*\n?', ''), '(^|\n)[ \t]*```$', ''), '^python\n*', '') ELSE {strip('raw')} END AS code FROM {FENCED_SQL}"""),
    "parse_plan_json": (lambda s, d: X.parse_plan_json(_plans(s, d), "doc_id", "raw", FALLBACK), """SELECT doc_id, CAST(i AS INTEGER) AS step_number, a[i] AS step FROM
      (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN [lang, source, n_chars::VARCHAR] ELSE ['overview', 'duplicates'] END AS a FROM documents), (SELECT unnest(range(1, 4)) AS i)
      WHERE i <= len(a)"""),
    "extract_message_text": (lambda s, d: _replies(s, d).select("conv_id", "turn", X.extract_message_text(F.col("reply")).alias("text")),
                             "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN text ELSE '' END AS text FROM conversations"),
    "extract_tool_calls": (lambda s, d: X.extract_tool_calls(_replies(s, d), ["conv_id", "turn"], "reply").select(
        "conv_id", "turn", "call_id", "name", F.col("arguments")["expression"].alias("expression"), F.col("arguments")["reason"].alias("reason")),
        "SELECT conv_id, turn, conv_id || '-' || turn AS call_id, 'query_table' AS name, text AS expression, role AS reason FROM conversations WHERE role = 'user'"),
    "clean_markdown": (on("documents", lambda d: d.select("doc_id", X.clean_markdown(F.col("text")).alias("text"))), f"SELECT doc_id, {clean('text')} AS text FROM documents"),
    "split_report_lines": (on("documents", lambda d: X.split_report_lines(d, ["doc_id"], "text")), f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line,
      CASE WHEN t = '' THEN 'empty' WHEN t LIKE '## %' THEN 'h2' WHEN t LIKE '# %' THEN 'h1' WHEN t LIKE '- %' OR t LIKE '* %' THEN 'bullet' ELSE 'body' END AS kind,
      CASE WHEN t LIKE '## %' THEN substr(t, 4) WHEN t LIKE '# %' THEN substr(t, 3) WHEN t LIKE '- %' OR t LIKE '* %' THEN {clean("('• ' || substr(t, 3))")} ELSE {clean('t')} END AS text
      FROM (SELECT doc_id, i, {strip('a[i]')} AS t FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""),
    "truncate_text": (on("documents", lambda d: d.select("doc_id", X.truncate_text(F.col("text")).alias("text"), X.tail_text(F.col("text")).alias("tail"), X.first_lines(F.col("text"), 2).alias("head"))),
                      f"""SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '... [truncated, ' || length(text) || ' chars total]' ELSE text END AS text,
                      right({strip('text')}, 600) AS tail, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head FROM documents"""),
    "format_count": (on("lineitem", lambda d: d.groupBy("l_returnflag").agg(X.format_count(F.sum("l_orderkey")).alias("total"))), "SELECT l_returnflag, format('{:,}', CAST(sum(l_orderkey) AS BIGINT)) AS total FROM lineitem GROUP BY 1"),
    "file_extension": (on("pages", lambda d: d.select("page_id", X.file_extension(F.col("url")).alias("extension"))), "SELECT page_id, upper(string_split(url, '.')[-1]) AS extension FROM pages"),
}


def _reused(spark, sf: str) -> DataFrame:
    with S.reuse_input(table(spark, sf, "lineitem"), ["l_quantity"]) as kept:
        first = kept.agg(F.count("*").alias("rows")).first()["rows"]
        return kept.agg(F.lit(first).cast("bigint").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
