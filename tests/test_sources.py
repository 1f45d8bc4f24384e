"""CSV oddities, cleaning, workbooks, files, logs and the log stream."""

import base64
import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F, types as T

from tablescope.operators import logs as G
from tablescope.registry.frames import workbooks
from tablescope.session import scratch_path
from tablescope.sources import clean as N, files as P, tables as S, workbooks as B
from tablescope.streaming.log_counts import compact, stream_log_counts, total_counts, windowed_calls

CSV = "i,f,b,dt,na,s,m\n1,1.5,True,2024-01-01,NA,x,1\n2,,False,2024-01-02,,y,abc\n,3,True,2024-01-03,null,,3\n"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_types_and_missing_tokens(spark, folder):
    df = S.load_csv(spark, put(folder, "a.csv", CSV))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "dt": "timestamp_ntz", "na": "string", "s": "string", "m": "string"}
    rows = df.orderBy("dt").collect()
    assert [r["na"] for r in rows] == [None] * 3 and [r["i"] for r in rows] == [1, 2, None]
    assert [r["m"] for r in N.coerce_numeric(df, ["m"]).orderBy("dt").collect()] == [1.0, None, 3.0]
    assert N.coercion_report(df, ["m"]).first()["coerced"] == 1


def test_csv_with_schema_needs_no_inference(spark, folder):
    schema = T.StructType.fromDDL("i bigint, f double, b boolean, dt date, na string, s string, m double")
    df = S.load_csv(spark, put(folder, "a.csv", CSV), schema)
    assert df.schema == schema
    assert [r["m"] for r in df.orderBy("dt").collect()] == [1.0, None, 3.0]


def test_csv_headers_quotes_and_empty_file(spark, folder):
    df = S.load_csv(spark, put(folder, "b.csv", 'a,a,,"x ""y"""\n1,2,3,"p,q"\n'))
    assert df.columns == ["a", "a.1", "Unnamed: 2", 'x "y"']
    assert df.first()[3] == "p,q"
    with pytest.raises(S.EmptyTableError):
        S.load_csv(spark, put(folder, "c.csv", ""))
    text = put(folder, "d.csv", 'k,t\n1,"two\nlines"\n')
    assert S.load_csv(spark, text, multiline=True).first()["t"] == "two\nlines"


def test_numbers_with_type_suffix_are_text(spark):
    df = spark.createDataFrame([(v,) for v in ("1d", "2.5F", "1e3", "-.5", "0x10", " 7 ", "d")], "x string")
    assert [r["x"] for r in N.coerce_numeric(df, ["x"]).collect()] == [None, None, 1000.0, -.5, None, 7.0, None]


def test_dates_need_a_share_of_parsed_values(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("03/04/2024", "x"), ("2024-01-05 10:00:00", "y")], "a string, b string")
    parsed = N.parse_datetimes(df)
    assert dict(parsed.dtypes) == {"a": "timestamp_ntz", "b": "string"}
    assert sorted(r["a"] for r in parsed.collect())[1:] == [dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 3, 4)]


def test_dispatch_by_extension(spark, folder):
    assert S.load_table(spark, put(folder, "a.TSV", "a\tb\n1\tx\n")).first()["b"] == "x"
    assert S.load_table(spark, put(folder, "a.dat", "a,b\n1,x\n")).columns == ["a", "b"]
    with pytest.raises(S.UnknownFormatError):
        S.load_table(spark, put(folder, "a.xls", "x"))
    with pytest.raises(S.UnknownFormatError):
        S.load_table(spark, put(folder, "empty.dat", ""))
    S.write_table(S.load_table(spark, put(folder, "z.csv", CSV)), folder + "/z.parquet")
    assert S.load_table(spark, folder + "/z.parquet").count() == 3


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_workbooks_from_files(spark, folder, kind):
    df = spark.createDataFrame([(i % 3, i, i / 4, f"t<{i}>" if i != 4 else "NA") for i in range(20)], "part int, k bigint, x double, s string")
    for row in workbooks(df, "part", "k", kind).collect():
        with open(os.path.join(folder, row["path"]), "wb") as f:
            f.write(bytes(row["content"]))
    got = S.load_table(spark, f"{folder}/*.{kind}").orderBy("k")
    assert dict(got.dtypes) == {"k": "bigint", "s": "string", "x": "double"}
    assert [(r["k"], r["x"], r["s"]) for r in got.collect()] == [(i, i / 4, f"t<{i}>" if i != 4 else None) for i in range(20)]
    typed = S.load_table(spark, f"{folder}/*.{kind}", schema=T.StructType.fromDDL("k string, x double"))
    assert dict(typed.dtypes) == {"k": "string", "x": "double"}


def test_shared_strings_and_cell_references():
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row><c r="B2"><v>5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert list(B.xlsx_rows(buffer.getvalue())) == [["a", None, "bc"], [None, "5", "true"]]


def test_files_keep_the_first_of_equal_content(spark):
    rows = [("p/plot_1_2.png", b"x"), ("p/plot_1_10.png", b"x"), ("p/plot_1_3.png", b"y"), ("p/plot_1.png", b"z"), ("p/plot_2.png", b"x"), ("p/other.png", b"q")]
    got = P.dedup_files(spark.createDataFrame(rows, "path string, content binary")).orderBy("step", "sub").collect()
    assert [(r["step"], r["sub"], r["path"][2:]) for r in got] == [(1, 2, "plot_1_2.png"), (1, 3, "plot_1_3.png"), (2, 0, "plot_2.png")]
    assert got[0]["sha256"] == hashlib.sha256(b"x").hexdigest()


def test_input_is_released_after_the_run(spark):
    with S.reuse_input(spark.range(10).toDF("a"), ["a"]) as kept:
        assert kept.is_cached and kept.count() == 10
    assert not kept.is_cached


def log_rows(spark, hours, n=40):
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(60 * hours * i / n)), f"r{i % 3}", "llm_call" if i % 5 else "agent_start", "ab"[i % 2], i, 10 + i, i)
         for i in range(n)], "ts timestamp, run_id string, event string, agent string, call_number int, input_tokens bigint, output_tokens bigint")


def test_stream_equals_batch_and_resumes(spark, folder):
    path, out = folder + "/log", scratch_path(spark, "t")
    G.write_run_log(log_rows(spark, 5), path)
    first = stream_log_counts(spark, path, out=out)
    G.write_run_log(log_rows(spark, 5, 60), path)
    put(folder + "/log", "broken.json", "{oops\n")
    second = stream_log_counts(spark, path, out=out, files_per_batch=1)
    batch = windowed_calls(G.read_run_log(spark, path), "1 hour")
    assert sorted(second.collect()) == sorted(batch.collect())
    assert first.agg(F.sum("calls")).first()[0] < second.agg(F.sum("calls")).first()[0] if first.count() else True
    overall = G.log_token_totals(G.read_run_log(spark, path)).where("agent is null").first()
    assert overall["calls"] == second.agg(F.sum("calls")).first()[0]


def test_stream_counts_records_that_come_days_late(spark, folder):
    path, shift = folder + "/log", F.expr("make_dt_interval(day)")
    for day in (10, 11, 12, 1):
        G.write_run_log(log_rows(spark, 3, 15).withColumn("day", F.lit(day)).withColumn("ts", F.col("ts") + shift).drop("day"), path)
    stream = stream_log_counts(spark, path, out=scratch_path(spark, "late"), files_per_batch=1)
    batch = windowed_calls(G.read_run_log(spark, path), "1 hour")
    assert sorted(stream.collect()) == sorted(batch.collect()) and len({r["start"].date() for r in batch.collect()}) == 4


def test_malformed_lines_are_counted(spark, folder):
    os.mkdir(folder + "/l")
    put(folder + "/l", "a.json", '{"ts": "2024-01-01T00:00:00", "event": "x"}\n{bad\n{"event": "y"}\n')
    row = G.malformed_lines(G.read_run_log(spark, folder + "/l")).first()
    assert (row["lines"], row["events"], row["malformed"]) == (3, 2, 1)


def test_delta_totals_accept_both_spellings_and_stay_positive(spark):
    rows = [("s", "pipeline", 3, 100, None), ("s", "chat", 1, 20, None), ("s", "current", 6, 150, 7), ("t", "current", 1, 5, 5), ("t", "pipeline", 4, 50, 9)]
    got = {(r["k"], r["phase"]): (r["calls"], r["input_tokens"], r["output_tokens"], r["total_tokens"]) for r in G.log_delta_totals(
        spark.createDataFrame(rows, "k string, phase string, calls bigint, input bigint, output_tokens bigint"), "k").collect()}
    assert got[("s", "delta")] == (2, 30, 7, 37) and got[("s", "chat")] == (3, 50, 7, 57) and got[("s", "total")] == (6, 150, 7, 157)
    assert got[("t", "delta")] == (0, 0, 0, 0) and got[("t", "total")] == (4, 50, 9, 59)


def test_workbooks_keep_every_cell(spark):
    import io
    import zipfile

    def packed(name, xml):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(name, xml)
        return buffer.getvalue()

    cell = lambda text: f"<t:table-cell><x:p>{text}</x:p></t:table-cell>"
    empty = '<t:table-cell t:number-columns-repeated="1000"/>'
    ods = packed("content.xml", '<d xmlns:t="t" xmlns:x="x"><t:table><t:table-row>' + cell("h") + empty + cell("i") + empty + "</t:table-row></t:table></d>")
    assert list(B.ods_rows(ods)) == [["h", *[None] * 1000, "i"]]
    line = lambda *texts: "<row>" + "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' if t else "<c/>" for t in texts) + "</row>"
    sheet = line("a", "a") + line("1", "2", "3") + line("4", "5", "", "")
    xlsx = packed("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
    rows = B.parse_workbooks(spark.createDataFrame([("x", xlsx)], "path string, content binary"), B.xlsx_rows).orderBy("row").collect()
    assert [{k: v for k, v in r["cells"].items() if v is not None} for r in rows] == [{"a": "1", "a.1": "2", "Unnamed: 2": "3"}, {"a": "4", "a.1": "5"}]


def test_no_cell_of_a_csv_folder_is_lost(spark, tmp_path):
    put(tmp_path, "one.csv", "a,b\n1,x\n2,y,EXTRA\n")
    put(tmp_path, "two.csv", "b,a\nz,3\n")
    put(tmp_path, "three.csv", 'c,a\n"p,q",4\n,5,\nshort\n')
    df = S.load_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c", "_rescued"] and dict(df.dtypes)["a"] == "bigint"
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [(1, "x", None, None), (2, "y", None, "2,y,EXTRA"), (3, "z", None, None), (4, None, "p,q", None), (5, None, None, None), (None, None, "short", None)], key=str)
    assert df.select("_rescued").dropna().collect() == [("2,y,EXTRA",)] and df.where("_rescued is not null").select("a").collect() == [(2,)]
    assert df.select("a").agg(F.sum("a")).first()[0] == 15
    declared = S.load_csv(spark, str(tmp_path), T.StructType.fromDDL("a int, c string, _rescued string"))
    assert declared.columns == ["a", "c", "_rescued"] and declared.where("_rescued is not null").first()["a"] == 2
    assert sorted(map(tuple, S.csv_report(spark, str(tmp_path)).collect())) == [("one.csv", 2, 1), ("three.csv", 3, 0), ("two.csv", 1, 0)]


def test_rescued_records_of_multiline_files(spark, tmp_path):
    put(tmp_path, "m.csv", 'a,"b\nc"\n1,"two\nlines"\n2,x,"more\nthan"\n')
    df = S.load_csv(spark, str(tmp_path), multiline=True)
    assert df.columns == ["a", "b\nc", "_rescued"]
    rows = sorted(map(tuple, df.collect()))
    assert rows[0] == (1, "two\nlines", None) and rows[1][:2] == (2, "x") and "more" in rows[1][2]


def test_losses_are_counted(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "01/31/2024"), (None, "soon"), ("2.5", None)], "n string, d string")
    assert N.datetime_report(df, ["d"]).first()["lost"] == 1 and N.datetime_report(df).count() == 2
    report = {r["column"]: tuple(r)[1:] for r in N.schema_report(df, T.StructType.fromDDL("n int, d date")).collect()}
    assert report == {"n": (3, 1 if df.selectExpr("try_cast('2.5' as int) as x").first()["x"] is not None else 2), "d": (3, 2)}


def test_tree_is_read_twice_but_its_contents_only_where_kept(spark, tmp_path):
    files = {"a/plot_1_1.png": b"same", "a/plot_1_2.png": b"same", "a/plot_1_3.png": b"other" * 50, "a/plot_2.png": b"single", "a/plot_1.png": b"no",
             "b c/plot_1_1.png": b"same", "b c/note.txt": b"x", "b c/odd.png": b"y"}
    for name, content in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    df = P.dedup_tree(spark, str(tmp_path))
    got = sorted((r["step"], r["sub"], r["path"].split(str(tmp_path))[1][1:].replace("%20", " "), r["content_base64"]) for r in df.collect())
    kept = ["a/plot_1_1.png", "a/plot_1_3.png", "a/plot_2.png", "b c/plot_1_1.png"]
    assert [(g[2], base64.b64decode(g[3])) for g in sorted(got, key=lambda g: g[2])] == [(k, files[k]) for k in kept]
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(str(tmp_path))
    assert sorted(map(tuple, P.dedup_files(whole).collect())) == sorted(map(tuple, df.collect()))
    assert sorted(f.rsplit("/", 1)[1] for f in df.inputFiles() if f.endswith(".png")) == sorted(k.rsplit("/", 1)[1] for k in kept)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "content" in x]
    assert P.dedup_tree(spark, str(tmp_path), "*.jpg").count() == 0


def test_stream_generations(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()

    def add(first, last):
        for i in range(first, last):
            (log / f"f{i}.json").write_text(f'{{"ts":"2024-01-01T0{i % 10}:10:00","event":"llm_call","agent":"a{i % 2}","input_tokens":{i},"output_tokens":1}}\n')

    def rows(df):
        return sorted((str(r["start"]), r["agent"], r["calls"], r["input_tokens"], r["output_tokens"]) for r in df.collect())

    def folders(name):
        return sorted(os.listdir(f"{out}/{name}")) if os.path.isdir(f"{out}/{name}") else []

    add(0, 8)
    got = rows(stream_log_counts(spark, str(log), out=out, files_per_batch=1, every=3))
    assert sum(r[3] for r in got) == sum(range(8)) and folders("generations") == ["upto=5"] and len(folders("batches")) == 2
    # a batch that is already in the generation is replayed, a write of the next generation was cut short, and old folders were left
    spark.createDataFrame([("a0", 9, 9, 9)], "agent string, calls long, input_tokens long, output_tokens long").selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' as start", "*").write.parquet(f"{out}/batches/b=4")
    os.makedirs(f"{out}/generations/upto=8")
    (tmp_path / "out/generations/upto=8/part-0.parquet").write_bytes(b"broken")
    assert rows(total_counts(spark, out)) == got
    compact(spark, out, 5)
    assert rows(total_counts(spark, out)) == got and folders("batches") == ["b=6", "b=7"]
    add(8, 10)
    again = rows(stream_log_counts(spark, str(log), out=out, files_per_batch=1, every=3))
    assert sum(r[3] for r in again) == sum(range(10)) and folders("generations") == ["upto=8"] and folders("batches") == ["b=9"]
