"""A third of all rows in one value, time, key or group of copies: results stay whole and equal brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import categorical as C, hypothesis as T, logs as G, numeric as U, overview as O, relations as L, timeseries as M
from tablescope.plans import fourier, quantiles
from tablescope.plans.ordered import cut_along
from tablescope.plans.quantiles import group_quantiles
from tablescope.plans.ranks import rank_columns
from tablescope.session import materialize

N = 3000


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    hot = np.arange(N) < N // 3
    return pd.DataFrame({
        "id": np.arange(N), "v": np.where(hot, 7.0, rng.normal(size=N).round(2)), "w": rng.normal(size=N),
        "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.where(hot, 64 * 86400, rng.integers(0, 90 * 86400, N)), "s"),
        "g": np.where(hot, "hot", rng.choice(list("abc"), N)),
    })


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(6)


def test_hot_value_statistics(df, pdf):
    got = {r["column"]: r for r in U.numeric_describe(df, ["v"]).collect()}["v"]
    want = pdf.v.describe()
    assert [got[c] for c in ("n", "mean", "sd", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(want))
    top = C.top_value(df, ["v"]).first()
    assert (top["value"], top["n"]) == ("7.0", N // 3 + int((pdf.v[N // 3:] == 7).sum()))


def test_hot_value_ranks(df, pdf):
    r = L.spearman_matrix(df, ["v", "w"]).first()["r"]
    assert r == pytest.approx(pdf.v.rank().corr(pdf.w.rank()))
    h = T.kruskal_wallis(df, "g", "v").first()["h"]
    k = pdf.v.rank()
    raw = 12 / (N * (N + 1)) * (k.groupby(pdf.g).sum() ** 2 / pdf.g.value_counts()).sum() - 3 * (N + 1)
    t = pdf.v.value_counts()
    assert h == pytest.approx(raw / (1 - (t ** 3 - t).sum() / (N ** 3 - N)))


def test_ranks_of_all_columns_at_once(spark, pdf):
    rng = np.random.default_rng(3)
    frame = pdf[["v", "w"]].assign(few=rng.integers(0, 4, N), hole=np.where(rng.random(N) < 0.4, np.nan, rng.normal(size=N).round(1)))
    views = [("v", None), ("w", "hole"), ("few", "hole"), ("hole", None), ("few", None)]
    got = rank_columns(spark.createDataFrame(frame).repartition(3), views).toPandas()
    want = pd.DataFrame({f"r{i}": (frame[a].where(frame[b].notna()) if b else frame[a]).rank() for i, (a, b) in enumerate(views)})
    by = lambda t: sorted(map(tuple, t.fillna(-1).to_numpy()))
    assert by(got) == by(want)
    assert rank_columns(spark.createDataFrame(frame).where("w > 1e9"), views).count() == 0


def test_hot_group_quantiles(df, pdf):
    for r in group_quantiles(df, ["g"], "w", [.25, .5]).collect():
        assert [r["q0"], r["q1"]] == pytest.approx(list(np.quantile(pdf.w[pdf.g == r["g"]], [.25, .5])))


def test_pieces_of_a_hot_group_stay_small(spark, monkeypatch):
    """One group of a third of the rows, whose values crowd at one end of every bracket, and one of a single value."""
    rng = np.random.default_rng(5)
    n = 60_000
    g = np.where(np.arange(n) < n // 3, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 50 == 1, "one", g), "v": np.exp(rng.normal(size=n) * 9)})
    pdf.loc[pdf.g == "one", "v"] = 4.0
    frame = spark.createDataFrame(pdf).repartition(5)
    sizes, found = [], materialize

    def watched(df, name):
        table = found(df, name)
        if name == "ranked-pieces":
            sizes.append(table.groupBy("g", "_p").count().agg(F.max("count")).first()[0])
        return table

    monkeypatch.setattr(quantiles, "materialize", watched)
    monkeypatch.setattr(quantiles, "PIECE_ROWS", 30)
    probs = [0.0, 0.1, 0.5, 0.501, 1.0]
    got = {r["g"]: list(r[1:]) for r in group_quantiles(frame, ["g"], "v", probs).collect()}
    assert got.keys() == set(pdf.g)
    for name, values in got.items():
        assert values == pytest.approx(list(np.quantile(pdf.v[pdf.g == name], probs)), rel=1e-12)
    assert len(sizes) > 1 and sizes[0] < n / 30 and sizes[-1] <= 30


def test_pieces_of_columns_stay_small(spark, df, pdf, monkeypatch):
    monkeypatch.setattr(quantiles, "PIECE_ROWS", 7)
    found = quantiles.column_quantiles(df, ["v", "w"], [.25, .5, .9])
    for c in ("v", "w"):
        assert list(found[c].values()) == pytest.approx(list(np.quantile(pdf[c], [.25, .5, .9])))


def test_hot_time(df, pdf):
    got = M.gap_stats(df, "t").first()
    want = pdf.t.sort_values().diff().dt.total_seconds().describe()
    assert [got[c] for c in ("n", "mean", "sd", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(want))
    means = {r["id"]: r["rolling_mean"] for r in M.rolling_mean(df, "t", "w", ["id"], days=10).collect()}
    assert len(means) == N
    ts, w = pdf.t.to_numpy(), pdf.w.to_numpy()
    for i in range(0, N, 97):
        inside = (ts <= ts[i]) & (ts > ts[i] - np.timedelta64(10, "D"))
        assert means[i] == pytest.approx(w[inside].mean())


def test_hot_key_rolling(df, pdf):
    means = {r["id"]: r["rolling_mean"] for r in M.rolling_mean(df, "t", "w", ["id"], ["g"], days=3).collect()}
    ts, w, g = pdf.t.to_numpy(), pdf.w.to_numpy(), pdf.g.to_numpy()
    for i in range(0, N, 97):
        inside = (ts <= ts[i]) & (ts > ts[i] - np.timedelta64(3, "D")) & (g == g[i])
        assert means[i] == pytest.approx(w[inside].mean())


def test_hot_time_autocorrelation_and_copies(spark, df, pdf):
    def acf(x, k):
        c = x - x.mean()
        return [float(c[: len(c) - h] @ c[h:] / (c @ c)) for h in range(k + 1)]

    ordered = pdf.sort_values(["t", "id"]).w.to_numpy()
    got = [r["r"] for r in M.autocorrelation(df, "w", "t", "id", 5, block=100).orderBy("lag").collect()]
    assert got == pytest.approx(acf(ordered, 5))
    # a third of the rows are copies of one row, the order key included
    copies = pdf.assign(id=np.where(pdf.g == "hot", 0, pdf.id), w=np.where(pdf.g == "hot", 2.5, pdf.w))
    ordered = copies.sort_values(["t", "id"]).w.to_numpy()
    got = [r["r"] for r in M.autocorrelation(spark.createDataFrame(copies), "w", "t", "id", 5, block=64).orderBy("lag").collect()]
    assert got == pytest.approx(acf(ordered, 5))


def test_hot_time_is_cut_along_the_tie_column(df, pdf):
    rows = df.select(F.unix_micros(F.col("t").cast("timestamp")).alias("t"), "id")
    cut, buckets = cut_along(rows, "t", "id", parts=12)
    sizes = [r["count"] for r in cut.groupBy(*buckets).count().collect()]
    assert sum(sizes) == N and max(sizes) < N / 5


def test_copies_are_counted_once_each(spark, pdf):
    frame = spark.createDataFrame(pd.concat([pdf[["g", "v"]]] * 3))
    distinct = pdf[["g", "v"]].drop_duplicates().shape[0]
    assert O.duplicate_row_count(frame).first()[0] == 3 * N - distinct
    assert O.duplicate_rows(frame).agg(F.sum("n")).first()[0] == 3 * N


def test_hot_run_in_logs(spark):
    rng = np.random.default_rng(12)
    n = 900
    run = np.where(np.arange(n) < n // 3, "hot", rng.choice(list("xyz"), n))
    log = pd.DataFrame({
        "run_id": run, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 50, n), "min"), "event": "llm_call", "agent": "a",
        "call_number": np.arange(n), "input_tokens": rng.integers(1, 100, n), "output_tokens": rng.integers(1, 9, n)})
    got = G.log_running_totals(spark.createDataFrame(log)).toPandas()
    want = log.sort_values(["ts", "call_number"])
    want["total"] = want.groupby("run_id").input_tokens.cumsum()
    assert sorted(zip(got.run_id, got.cumulative_input)) == sorted(zip(want.run_id, want.total))
    steps = spark.createDataFrame(
        [(r, i, "s", f"out {i}", None, 0) for i, r in enumerate(run)], "run_id string, step_number int, step string, text_output string, error string, charts int")
    parts = G.context_pack(steps, part_steps=50).collect()
    assert max(p["steps"] for p in parts) == 50
    whole = "".join(p["text"] for p in sorted(parts, key=lambda p: p["part"]) if p["run_id"] == "hot")
    assert whole.count("--- Step") == n // 3 and whole.index("out 0") < whole.index("out 1\n") < whole.index("out 299")


@pytest.mark.parametrize("group", [8, 64, 1 << 20])
def test_all_lags_with_copies(spark, df, pdf, monkeypatch, group):
    monkeypatch.setattr(fourier, "GROUP", group)
    copies = pdf.assign(id=np.where(pdf.g == "hot", 0, pdf.id), w=np.where(pdf.g == "hot", 2.5, pdf.w))[::5 if group == 8 else 1]
    x = copies.sort_values(["t", "id"]).w.to_numpy()
    x = x - x.mean()
    got = M.autocorrelation(spark.createDataFrame(copies).repartition(3), "w", "t", "id").toPandas()
    assert got.lag.tolist() == list(range(len(x)))
    assert got.r.to_numpy() == pytest.approx(np.correlate(x, x, "full")[len(x) - 1:] / (x @ x), abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_all_lags_of_short_series(spark, n):
    frame = spark.createDataFrame([(i, float(i * i)) for i in range(n)], "i long, v double")
    x = np.arange(n) ** 2 - np.mean(np.arange(n) ** 2) if n else np.zeros(0)
    got = [r["r"] for r in M.autocorrelation(frame, "v", "i", "i").collect()]
    assert got == ([None] if n == 1 else pytest.approx(np.correlate(x, x, "full")[n - 1:] / (x @ x)) if n else [])


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_results_do_not_depend_on_partitioning(df, pdf, pieces):
    shuffled = df.repartition(pieces, F.rand(pieces))
    q = U.quantiles(shuffled, ["v", "w"]).orderBy("column", "q").collect()
    assert q == U.quantiles(df, ["v", "w"]).orderBy("column", "q").collect()
    assert T.mann_whitney(shuffled, "g", "v", "a", "b").first() == T.mann_whitney(df, "g", "v", "a", "b").first()
    hist = U.histogram(shuffled, ["v"], 7).collect()
    assert sum(r["n"] for r in hist) == N


def test_values_to_rank_travel_in_blocks(spark, pdf, monkeypatch):
    from tablescope.plans import ranks

    monkeypatch.setattr(ranks, "PIECE_ROWS", 10)  # pieces are cut again
    got = rank_columns(spark.createDataFrame(pdf[["v", "w", "g"]]).repartition(3), [("v", None), ("w", None)], keep=["g"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = pdf[["v", "w"]].rank().assign(g=pdf.g)
    assert sorted(map(tuple, got.toPandas().to_numpy())) == sorted(map(tuple, want.to_numpy()))
