"""The full run, the report, the isolation forest and the text functions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import text as X
from tablescope.operators import hypothesis as T, logs as G, overview as O, relations as L, report as R
from tablescope.operators.iforest import as_arrays, grow, isolation_forest, mean_path, path_lengths
from tablescope.session import scratch_path


def test_run_isolates_errors_and_counts_attempts(spark, read):
    calls = []

    def flaky(d):
        calls.append(1)
        if len(calls) < 2:
            raise RuntimeError("lost executor")
        return d.limit(1)

    steps = [("shape", O.dataset_shape), ("bad", lambda d: d.select("nothing")), ("flaky", flaky)]
    profile = R.run_profile(read("orders"), scratch_path(spark, "p"), steps)
    got = {r["step"]: r for r in profile.steps.collect()}
    assert (got["shape"]["error"], got["shape"]["attempts"]) == (None, 1) and "1500" in got["shape"]["text_output"]
    assert "AnalysisException" in got["bad"]["error"] and got["bad"]["attempts"] == 1
    assert (got["flaky"]["error"], got["flaky"]["attempts"]) == (None, 2)
    status = G.step_status(profile.steps).first()
    assert (status["total"], status["successful"], status["failed"], status["retried"]) == (3, 2, 1, 1)
    assert set(profile.results) == {"shape", "flaky"}


def test_full_run_has_no_failed_step_and_covers_every_column(spark, read):
    orders = read("orders")
    profile = R.run_profile(orders, scratch_path(spark, "p"))
    assert profile.steps.where("error is not null").select("step", "error").collect() == []
    assert O.column_coverage(orders, profile.results, profile.sources).where("n = 0").count() == 0
    assert R.coverage_gaps(orders, profile).count() == 0
    assert profile.sources["counts_by_year_o_orderdate"] == ["o_orderdate"] and set(profile.sources["trend_lines_o_orderdate"]) >= {"o_orderdate", "o_totalprice"}
    del profile.results["gap_stats_o_orderdate"], profile.results["histogram"]
    gaps = {(r["column"], r["analysis"]) for r in R.coverage_gaps(orders, profile).collect()}
    assert gaps == {("o_orderdate", "gap_stats"), *[(c, "histogram") for c in ("o_orderkey", "o_custkey", "o_totalprice")]}
    text = R.write_report(profile, R.insights(orders), scratch_path(spark, "r"))
    assert all(f"## {s}" in text for s in R.SECTIONS) and all(c in text for c in orders.columns)


def test_report_names_tests_anomalies_and_small_ranges(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    x[0] = 40.0
    pdf = pd.DataFrame({"x": x, "tiny": rng.uniform(1e-6, 9e-6, 400), "g": rng.choice(["a", "b", "c"], 400), "h": None})
    pdf.loc[pdf.g == "a", "x"] += 2
    df = spark.createDataFrame(pdf, "x double, tiny double, g string, h string")
    rows = [(r["section"], r["text"]) for r in R.insights(df).collect()]
    stats, links, odd = ([t for s, t in rows if s == name] for name in ("statistics", "relations", "anomalies"))
    assert any(t.startswith("x: not normal (p = ") for t in stats)
    assert any(t.startswith("x by g: 3 groups, H = ") and t.endswith("p = 0.0") for t in links) and any("and x: " in t or "x and tiny: " in t for t in links)
    assert "1 rows with a |z| above 3 in any column" in odd and any(t.endswith("flagged by the isolation forest") and not t.startswith("0 ") for t in odd)
    lo = R.column_summary(df).where("column = 'tiny'").first()["lo"]
    assert float(lo) == pytest.approx(pdf.tiny.min(), rel=1e-3)


def test_all_pairs_agree_with_single_pairs(spark, read):
    events = read("events").withColumn("half", F.col("event_id") % 2 == 0).withColumn("value", F.when(F.col("event_id") % 5 > 0, F.col("value")))
    assert L.group_columns(events) == ["event_type", "half"]
    tests = {(r["category"], r["column"]): r for r in T.all_group_tests(events).collect()}
    stats = L.all_group_stats(events).collect()
    assert len(tests) == 6
    for category in ("event_type", "half"):
        one = T.kruskal_wallis(events, category, "value").first()
        got = tests[category, "value"]
        assert [got[c] for c in ("groups", "n", "df")] == [one[c] for c in ("groups", "n", "df")]
        assert (got["h"], got["p"]) == (pytest.approx(one["h"]), pytest.approx(one["p"]))
        want = {str(r["group"]).lower(): tuple(r)[1:] for r in L.group_describe(events, category, "value").collect()}
        found = {r["value"]: (r["n"], r["mean"], r["sd"], r["min"], r["p25"], r["median"], r["p75"], r["max"]) for r in stats if (r["category"], r["column"]) == (category, "value")}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_lineage_follows_expressions(spark, read):
    base = read("lineitem").select((F.col("l_quantity") * F.col("l_tax")).alias("x"), "l_tax", F.col("l_returnflag").alias("flag"), "l_discount", "l_orderkey")
    grouped = base.groupBy("flag").agg(F.sum("x").alias("s"))
    assert O.lineage(base, grouped) == ["x", "l_tax", "flag"]
    assert O.lineage(base, base.where("l_discount > 0.05").select(F.count("*").alias("n"))) == ["l_discount"]
    assert O.lineage(base, base.select("flag", F.lit(1).alias("l_orderkey"))) == ["flag"]
    again = base.join(grouped, "flag").agg(F.max(F.col("s") - F.col("l_discount")).alias("m"))
    assert O.lineage(base, again) == ["x", "l_tax", "flag", "l_discount"]
    assert O.lineage(base, base.where(F.col("l_discount") > base.agg(F.avg("l_tax")).scalar()).select("flag")) == ["l_tax", "flag", "l_discount"]


def test_findings_are_ranked(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x, "z": rng.lognormal(sigma=.7, size=500)}))
    rows = R.key_findings(df).collect()
    assert rows[0]["kind"] == "correlation" and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["severity"] for r in rows] == sorted((r["severity"] for r in rows), reverse=True)
    assert {"skew", "outliers"} <= {r["kind"] for r in rows}


def test_isolation_forest_flags_far_points(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(4000, 3)), columns=list("abc"))
    pdf.loc[:9, ["a", "b"]] = 25.0
    pdf["id"] = np.arange(len(pdf))
    pdf.loc[100, "c"] = None
    df = spark.createDataFrame(pdf)
    got = isolation_forest(df, ["id"]).toPandas()
    assert len(got) == 3999 and got.is_outlier.mean() == pytest.approx(.05, abs=.005)
    assert got[got.id < 10].is_outlier.all() and got[got.id < 10].score.min() > got.score.quantile(.95)
    again = isolation_forest(df.repartition(9), ["id"]).toPandas()
    assert got.sort_values("id").score.to_numpy() == pytest.approx(again.sort_values("id").score.to_numpy())


def test_tree_paths():
    x = np.array([[0.0], [1.0], [2.0], [50.0]])
    t = grow(x, 1)
    depth = path_lengths(x, as_arrays(t), 2)
    assert depth.min() >= 1 and len(t) % 2 == 1 and mean_path(256) == pytest.approx(10.24, abs=.01)
    assert grow(np.zeros((5, 2)), 1).shape[0] == 1


TEXTS = {
    "plain": "plain", "  ```python\nx = 1\n```  ": "x = 1", "```\nx = 1": "x = 1", "```json\n[1]\n```": "[1]", "```\npython\ny\n ```": "y", "```": "", "a ``` b": "a ``` b",
}


def test_code_fences(spark):
    df = spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "raw string, want string")
    assert df.where(X.strip_code_fence(F.col("raw")) != F.col("want")).collect() == []


def test_plans_and_replies(spark):
    rows = [("a", '```json\n["x", "y"]\n```'), ("b", '["z"]'), ("c", "not json"), ("d", '```\n["q"]\n```\nmore')]
    got = X.parse_plan_json(spark.createDataFrame(rows, "k string, raw string"), "k", "raw", ["f1", "f2"]).orderBy("k", "step_number").collect()
    assert [(r["k"], r["step_number"], r["step"]) for r in got] == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "f1"), ("c", 2, "f2"), ("d", 1, "q")]
    reply = '{"output":[{"type":"function_call","call_id":"1","name":"n","arguments":"{\\"expression\\":\\"e\\",\\"reason\\":\\"r\\"}"},{"type":"message","content":[{"text":"hi"},{"text":"no"}]}]}'
    df = spark.createDataFrame([("a", reply), ("b", '{"output":[]}'), ("c", "broken")], "k string, reply string")
    assert [r[0] for r in df.orderBy("k").select(X.extract_message_text(F.col("reply"))).collect()] == ["hi", "", ""]
    call = X.extract_tool_calls(df, ["k"], "reply").collect()
    assert [(r["k"], r["call_id"], r["name"], r["arguments"]) for r in call] == [("a", "1", "n", {"expression": "e", "reason": "r"})]


def test_markdown_and_lines(spark):
    df = spark.createDataFrame([("# T\n\n## S\n- **b** & `c`\n* x\n text <i>",)], "t string")
    got = [(r["kind"], r["text"]) for r in X.split_report_lines(df, [], "t").orderBy("line").collect()]
    assert got == [("h1", "T"), ("empty", ""), ("h2", "S"), ("bullet", "• b &amp; c"), ("bullet", "• x"), ("body", "text &lt;i&gt;")]


def test_caps_and_formats(spark):
    row = spark.createDataFrame([("é" * 12, "a\nb\nc", "x.tar.GZ", 1234567)], "t string, l string, f string, n bigint").select(
        X.truncate_text(F.col("t"), 10).alias("t"), X.truncate_text(F.col("t"), 10, note=False).alias("c"), X.first_lines(F.col("l"), 2).alias("l"),
        X.tail_text(F.col("l"), 1).alias("r"), X.file_extension(F.col("f")).alias("f"), X.format_count(F.col("n")).alias("n")).first()
    assert row["t"] == "é" * 10 + "\n... [truncated, 12 chars total]" and row["c"] == "é" * 10
    assert (row["l"], row["r"], row["f"], row["n"]) == ("a\nb", "c", "GZ", "1,234,567")


CASES = [("AuthenticationError", "x", "auth"), ("E", "bad API_KEY", "auth"), ("E", "Timed out", "timeout"), ("E", "rate limit", "rate_limit"),
         ("FileNotFoundError", "x", "missing_file"), ("EmptyDataError", "x", "empty_file"), ("E", "No columns to parse", "empty_file"),
         ("ConnectError", "x", "connection"), ("E", "connection reset", "connection"), ("E", "x", "other")]


def test_error_classes(spark):
    df = spark.createDataFrame([(*c, "ctx") for c in CASES], "type string, message string, want string, context string")
    assert G.error_classes(df).where("class <> want").collect() == []
    assert G.error_counts(df).agg(F.sum("n")).first()[0] == len(CASES)


def test_the_report_ranks_the_table_once(spark, monkeypatch):
    from tablescope.plans import ranks

    df = spark.createDataFrame([(f"g{i % 3}", float(i * 7 % 50), float(i % 11), None if i % 5 == 0 else i * i % 17) for i in range(200)], "g string, a double, b double, c long")
    calls, cut = [], ranks.split_points
    monkeypatch.setattr(ranks, "split_points", lambda *a: calls.append(a) or cut(*a))
    shown = {r["text"] for r in R.insights(df).collect()}
    assert len(calls) == 1
    for r in T.all_group_tests(df).collect():
        assert any(t.startswith(f"{r['column']} by {r['category']}: {r['groups']} groups, H = {round(r['h'], 4)}") for t in shown)
    for r in T.correlation_choice(df).where("method = 'spearman'").collect():
        assert any(t.startswith(f"{r['col_a']} and {r['col_b']}: spearman r = {round(r['r'], 4)}") for t in shown)
