"""Missing values, constants, ties, empty and tiny inputs, compared with pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import (
    anomalies as A, categorical as C, features as E, hypothesis as T, missing as W, numeric as U, overview as O, query as Q,
    relations as L, report as R, timeseries as M,
)
from tablescope.plans.ordered import split_points
from tablescope.plans.quantiles import column_quantiles, group_quantiles, weighted_quantiles
from tablescope.plans.ranks import ranked_values

NAN = float("nan")


def by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture
def nan_frame(spark):
    return spark.createDataFrame([(1, NAN), (2, None), (3, 5.0), (4, -0.0), (5, 0.0)], "k bigint, x double")


def test_nan_and_null_are_one_missing_value(nan_frame):
    assert by(O.null_counts(nan_frame))["x"]["nulls"] == 2
    stats = by(U.numeric_describe(nan_frame, ["x"]))["x"]
    assert (stats["n"], stats["min"], stats["max"]) == (3, 0.0, 5.0)
    assert by(C.cardinality(nan_frame))["x"]["uniques"] == 2  # -0.0 and 0.0 are one value
    assert O.duplicate_row_count(nan_frame.select("x")).first()[0] == 2
    assert O.duplicate_row_count(nan_frame.select("x"), exact=True).first()[0] == 2


def test_null_position_matters_for_duplicates(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None), (None, None)], "a string, b string")
    assert O.duplicate_row_count(df).first()[0] == 1


@pytest.mark.parametrize("values", [[], [None, None], [4.0], [4.0, 4.0, 4.0], [1.0, 2.0], [1.0, None, 7.0, 7.0, 9.5]])
def test_describe_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = pd.Series(values, dtype=float)
    got = by(U.numeric_describe(df))["x"]
    want = {"n": s.count(), "mean": s.mean(), "sd": s.std(), "min": s.min(), "p25": s.quantile(.25), "p50": s.median(), "p75": s.quantile(.75), "max": s.max()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v) if not pd.isna(v) else got[k] is None, k


def test_skew_and_kurtosis_match_pandas(spark, read):
    s = read("events").toPandas()["value"]
    assert by(U.skewness(read("events")))["value"]["skew"] == pytest.approx(s.skew())
    assert by(U.kurtosis(read("events")))["value"]["kurt"] == pytest.approx(s.kurtosis())
    constant = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert by(U.skewness(constant))["x"]["skew"] is None


@pytest.mark.parametrize("k, accuracy, task_rows", [(16, 50, 10), (500, 500, 100), (32_768, 10_000, 5_000_000)])
def test_quantiles_are_exact_for_any_sketch(spark, monkeypatch, k, accuracy, task_rows):
    monkeypatch.setattr("tablescope.plans.quantiles.PIECE_ROWS", task_rows)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(size=4000), np.zeros(2000), rng.integers(0, 9, 1000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": rng.integers(0, 3, len(x))})).repartition(7)
    probs = [0, .001, .01, .25, .5, .75, .99, .999, 1]
    got = column_quantiles(df, ["x"], probs, k)["x"]
    assert [got[q] for q in probs] == pytest.approx(list(np.quantile(x, probs)))
    frame = df.toPandas()
    for row in group_quantiles(df, ["g"], "x", [.1, .5, .9], accuracy).collect():
        want = np.quantile(frame.x[frame.g == row["g"]], [.1, .5, .9])
        assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(list(want))


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "v double, n bigint")
    flat = np.repeat([1.0, 2.0, 9.0], [5, 1, 4])
    got = weighted_quantiles(df, "v", "n", [0, .3, .5, .55, 1])
    assert list(got.values()) == pytest.approx(list(np.quantile(flat, [0, .3, .5, .55, 1])))


def test_average_ranks_and_grouped_ties(spark):
    rows = [(1.0, "a"), (1.0, "b"), (2.0, "a"), (2.0, "b"), (2.0, "c"), (3.0, "c"), (None, "a")]
    df = spark.createDataFrame(rows, "x double, g string")
    ranks = {r["_value"]: r["rank"] for r in ranked_values(df, "x", [1.5, 2.5]).collect()}
    assert ranks == {1.0: 1.5, 2.0: 4.0, 3.0: 6.0}
    grouped = ranked_values(df, "x", split_points(df, ["x"])["x"], "g").collect()
    assert {(r["_value"], r["_group"]): (r["n"], r["ties"], r["rank"]) for r in grouped}[(2.0, "c")] == (1, 3, 4.0)


def test_correlation_pairs_use_complete_rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=list("abc"))
    pdf["b"] += 1e9 + pdf["a"]
    pdf.loc[rng.random(500) < .3, "a"] = None
    pdf.loc[rng.random(500) < .2, "c"] = None
    df = spark.createDataFrame(pdf.replace({np.nan: None})).repartition(5)
    want, got = pdf.corr(), L.corr_matrix(df).collect()
    assert len(got) == 9
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], abs=1e-6)
    ranks = {(r["col_a"], r["col_b"]): r["r"] for r in L.spearman_matrix(df).collect()}
    for (a, b), r in ranks.items():
        both = pdf[[a, b]].dropna().rank()
        assert r == pytest.approx(both[a].corr(both[b]), abs=1e-6)


def test_tests_on_ties_against_definitions(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(list("ab"), 300), "x": rng.integers(0, 20, 300).astype(float)})
    df = spark.createDataFrame(pdf)
    a, b = pdf.x[pdf.g == "a"].to_numpy(), pdf.x[pdf.g == "b"].to_numpy()
    u = sum((x > b).sum() + .5 * (x == b).sum() for x in a)
    one = T.mann_whitney(df, "g", "x").first()
    other = T.mann_whitney(df, "g", "x", "b", "a").first()
    assert one["u1"] == pytest.approx(u) and one["u1"] + other["u1"] == len(a) * len(b)
    assert one["p"] == pytest.approx(other["p"])
    h = T.kruskal_wallis(df, "g", "x").first()
    r = pdf.x.rank()
    n = len(pdf)
    raw = 12 / (n * (n + 1)) * sum(r[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in "ab") - 3 * (n + 1)
    t = pdf.x.value_counts()
    assert h["h"] == pytest.approx(raw / (1 - (t ** 3 - t).sum() / (n ** 3 - n)))
    assert T.group_comparison(df, "g", "x").first()["test"] == "mann_whitney"
    with pytest.raises(ValueError):
        T.mann_whitney(df.withColumn("g", F.lit("a")), "g", "x")


def test_normality_needs_eight_values(spark):
    assert by(T.normality_test(spark.createDataFrame([(float(i),) for i in range(7)], "x double")))["x"]["k2"] is None


def test_correlation_choice_takes_pearson_for_normal_columns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=400), "b": rng.normal(size=400), "c": rng.exponential(size=400)})
    got = {(r["col_a"], r["col_b"]): r["method"] for r in T.correlation_choice(spark.createDataFrame(pdf)).collect()}
    assert got == {("a", "b"): "pearson", ("a", "c"): "spearman", ("b", "c"): "spearman"}


def test_outliers_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None)] * 4, "x double, y double")
    assert [r["n_iqr"] for r in A.iqr_outlier_counts(df).collect()] == [0]
    assert {r["column"]: r["n_z"] for r in A.zscore_outlier_counts(df).collect()} == {"x": 0, "y": 0}
    assert A.zscore_row_flags(df.select("x")).count() == 0
    assert [r["n"] for r in U.histogram(df).collect()] == [4]


def test_zscores_on_complete_rows_use_population_sd(spark):
    x = [0.0] * 20 + [10.0]
    df = spark.createDataFrame([(v, 1.0 * i) for i, v in enumerate(x)] + [(99.0, None)], "x double, y double")
    z = abs(10 - np.mean(x)) / np.std(x)
    rows = A.zscore_row_flags(df).collect()
    assert [r["max_z"] for r in rows] == pytest.approx([z])


EMPTY_SAFE = [
    O.dataset_shape, O.column_info, O.column_classes, O.null_counts, O.total_nulls, O.column_overview, O.duplicate_row_count, O.duplicate_rows,
    O.describe_all, O.constant_columns, O.id_like_columns, U.numeric_describe, U.skewness, U.kurtosis, U.quantiles, U.shape_flags, U.histogram,
    U.boxplot_stats, C.value_counts, C.value_shares, C.cardinality_class, C.top_value, W.missing_ranking, W.high_missing_columns,
    lambda d: W.missing_heatmap(d, "k"), L.corr_matrix, L.spearman_matrix, L.corr_significance, T.normality_test, A.iqr_outlier_counts,
    A.zscore_outlier_counts, A.zscore_row_flags, A.outlier_ranking, E.log_candidates, E.encoding_advice, E.feature_advice, M.date_range,
    lambda d: M.gap_stats(d, "t"), lambda d: M.gap_list(d, "t"), lambda d: M.counts_by_month(d, "t"), lambda d: M.rolling_mean(d, "t", "x", ["k"]),
    lambda d: M.resample(d, "t", "x"), lambda d: M.time_trend(d, "t"), lambda d: M.autocorrelation(d, "x", "t", "k", 3),
    lambda d: L.group_describe(d, "c", "x"), lambda d: T.kruskal_wallis(d, "c", "x"), lambda d: E.bin_equal_width(d, "x"), lambda d: E.bin_quantile(d, "x"),
    lambda d: E.one_hot(d, "c"), lambda d: L.scatter_bins(d, "x", "k"), R.quality_issues, R.key_findings, R.column_summary,
]


@pytest.mark.parametrize("number", range(len(EMPTY_SAFE)))
@pytest.mark.parametrize("rows", [0, 1, 2])
def test_tiny_inputs_give_results_not_errors(spark, number, rows):
    data = [(1, 2.0, "a", dt.datetime(2024, 1, 1)), (2, None, None, None)][:rows]
    df = spark.createDataFrame(data, "k bigint, x double, c string, t timestamp_ntz")
    EMPTY_SAFE[number](df).collect()


def test_gaps_with_repeated_times_match_pandas(spark):
    t = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:00", "2024-01-01 06:00", "2024-01-03 00:00", "2024-01-01 00:00"])
    got = M.gap_stats(spark.createDataFrame(pd.DataFrame({"t": t})), "t").first()
    want = pd.Series(t).sort_values().diff().dt.total_seconds().describe()
    assert [got[c] for c in ("n", "mean", "sd", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(want))


def test_rolling_mean_before_1970_and_with_nulls(spark):
    days = [-40, -39.5, -10, -9, 0, 0, 20, 21, 51]
    pdf = pd.DataFrame({"k": range(len(days)), "t": [dt.datetime(1970, 1, 1) + dt.timedelta(days=d) for d in days], "v": [1, 2, None, 4, 5, 6, 7, 8, None]})
    df = spark.createDataFrame([(int(k), t.to_pydatetime(), None if math.isnan(v) else v) for k, t, v in pdf.itertuples(index=False)], "k bigint, t timestamp_ntz, v double")
    got = {r["k"]: r["rolling_mean"] for r in M.rolling_mean(df, "t", "v", ["k"], days=30).collect()}
    for k, d in enumerate(days):
        inside = [v for e, v in zip(days, pdf.v) if d - 30 < e <= d and not math.isnan(v)]
        assert got[k] == (pytest.approx(np.mean(inside)) if inside else None)


def test_autocorrelation_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=700).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(700), "x": x, "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(700) // 50, "h")})).repartition(6)
    c = x - x.mean()
    want = [float(c[: len(c) - h] @ c[h:] / (c @ c)) for h in range(11)]
    for block in (11, 64, 10_000):
        got = [r["r"] for r in M.autocorrelation(df, "x", "t", "i", 10, block=block).orderBy("lag").collect()]
        assert got == pytest.approx(want)


def test_transforms(spark):
    df = spark.createDataFrame([(0.0, "a"), (-2.0, None), (None, "b"), (3.0, "a")], "x double, c string")
    rows = E.transform_skewed(df, ["x"]).collect()
    assert [r["x_log"] for r in rows] == [None, None, None, pytest.approx(math.log(3))]
    assert [r["x_log1p"] for r in rows] == [0.0, None, None, pytest.approx(math.log(4))]
    hot = E.one_hot(df, "c").collect()
    assert [(r["c_a"], r["c_b"]) for r in hot] == [(1, 0), (0, 0), (0, 1), (1, 0)]
    assert sorted(r["c_freq"] or 0 for r in E.frequency_encode(df, "c").collect()) == pytest.approx([0, 1 / 3, 2 / 3, 2 / 3])
    wide = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        E.one_hot(wide, "c")


def test_query_text_and_guard(spark):
    df = spark.createDataFrame([(i, "x" * 60) for i in range(90)], "a bigint, b string")
    text = Q.query_text(df, "SELECT * FROM df ORDER BY a")
    assert "[truncated," in text and len(text) < 2100
    assert Q.query_text(df, "SELECT nothing FROM df").startswith("ERROR:")
    with pytest.raises(ValueError):
        Q.query_table(df, "DROP TABLE df")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "p", 2.0), (2.5, "q", 1.0), (4.0, "p", None)], "`a.b` double, `c d` string, `e``f` double")
    assert by(U.numeric_describe(df))["a.b"]["n"] == 3
    assert by(O.column_overview(df))["e`f"]["nulls"] == 1
    assert {r["n"] for r in L.corr_matrix(df).collect()} == {2, 3}
    assert R.column_summary(df).count() == 3
    assert E.bin_quantile(df, "a.b").count() == 3


def test_samples_are_the_lowest_hashes_whatever_the_partitioning(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 7).alias("x"))
    want = sorted(r[0] for r in df.orderBy(F.xxhash64(F.lit(42), "id")).limit(20).collect())
    assert sorted(r["id"] for r in Q.sample_rows(df.repartition(9), ["id"], 20).collect()) == want
    same_key = df.withColumn("k", F.lit(1))
    assert Q.sample_rows(same_key, ["k"], 20).count() == 20


def test_many_top_values(spark):
    df = spark.range(5000).select((F.col("id") % 1700).cast("string").alias("s"))
    rows = C.value_counts(df, ["s"], 1500).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1501)) and rows[0]["n"] == 3 and rows[-1]["n"] == 3
    assert [r["value"] for r in rows] == [r["value"] for r in C.value_counts(df, ["s"], 900).orderBy("rank").collect()] + [r["value"] for r in rows[900:]]


def test_distinct_counts_of_texts(spark):
    df = spark.createDataFrame([("a", None), ("a", "b"), (None, "b"), ("", None)], "x string, y string")
    got = by(C.cardinality(df))
    assert (got["x"]["uniques"], got["y"]["uniques"]) == (2, 1)


def test_ties_of_texts_that_begin_alike(spark):
    """Values that tie in count and in their first characters are ordered by the rest of them."""
    stem = "the same first characters of all "
    rows = [(f"{stem}{i % 40:02}",) for i in range(80)] + [("rare",), (None,), ("",), ("",), ("",)]
    got = C.value_counts(spark.createDataFrame(rows, "t string").repartition(5), ["t"], 4).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("t", "", 3, 1)] + [("t", f"{stem}{i:02}", 2, i + 2) for i in range(3)]
    assert C.top_value(spark.createDataFrame(rows[:80], "t string"), ["t"]).first()["value"] == stem + "00"
    assert C.value_counts(spark.createDataFrame([], "t string")).count() == 0


@pytest.mark.parametrize("most", [64, 1 << 26])
def test_repeated_rows_whatever_the_filter(spark, monkeypatch, most):
    monkeypatch.setattr(O, "MOST_BITS", most)
    rows = [(i % 500, float(i % 250) if i % 3 else None) for i in range(1_000)] + [(None, None)] * 2 + [(9_999, 0.0)]
    got = {tuple(r) for r in O.duplicate_rows(spark.createDataFrame(rows, "a int, b double")).collect()}
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    assert got == {(*r, n) for r, n in counts.items() if n > 1}
    assert O.duplicate_rows(spark.createDataFrame([], "a int")).count() == 0


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_without_zone_do_not_pass_through_the_session_zone(new_york):
    """02:30 does not exist in New York on that day, and 01:30 is there twice in autumn."""
    hours = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-03-10 03:30:00.25", "2024-11-03 01:30:00", "1969-12-31 23:59:59.999999"]
    df = new_york.createDataFrame([(h, i) for i, h in enumerate(hours)], "s string, i int").select(F.col("s").cast("timestamp_ntz").alias("t"), "i")
    three = df.where("i < 3")
    gaps = M.gap_stats(three, "t").first()
    assert (gaps["n"], gaps["min"], gaps["max"]) == (2, 3600.0, 3600.25)
    assert C.cardinality(df, ["t"]).first()["uniques"] == 5
    assert {r["value"] for r in C.value_counts(df, ["t"]).collect()} == {"2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-03-10 03:30:00.25", "2024-11-03 01:30:00", "1969-12-31 23:59:59.999999"}
    assert [r["t_hour"] for r in E.datetime_features(df, "t").orderBy("i").collect()] == [1, 2, 3, 1, 23]
    listed = M.gap_list(df.where("i < 4"), "t", 5).first()
    assert (listed["start"], listed["end"]) == (dt.datetime(2024, 3, 10, 3, 30, 0, 250_000), dt.datetime(2024, 11, 3, 1, 30))
    assert [str(r["period"]) for r in M.trend_line(three, "t", "i", "hour").collect()] == [f"2024-03-10 0{h}:00:00" for h in (1, 2, 3)]
    assert [str(r["period"]) for r in M.counts_by_week(three, "t").collect()] == ["2024-03-04 00:00:00"]


def test_instants_keep_their_distance(new_york):
    df = new_york.createDataFrame([(1710053400 + 3600 * i,) for i in range(3)], "s long").select(F.timestamp_seconds("s").alias("t"))
    assert M.gap_stats(df, "t").first()["max"] == 3600.0
    assert {r["value"] for r in C.value_counts(df, ["t"]).collect()} == {"2024-03-10 01:50:00", "2024-03-10 03:50:00", "2024-03-10 04:50:00"}
