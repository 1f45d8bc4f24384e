"""Time series, relations, tests, anomalies and feature queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as A, features as E, hypothesis as T, relations as L, timeseries as M
from ..operators.iforest import isolation_forest
from . import frames as FR
from .common import LINE_NUMBERS, Entry, on, r, rounded, table, union_all
from .profile import _k2

ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
DAY = 86_400_000_000
LINE_GROUPS = ("l_returnflag", "l_linestatus")


def _per(expression: str, name: str, frame: str) -> str:
    return f"SELECT {expression} AS period, count(*) AS n FROM {frame} WHERE {name} IS NOT NULL GROUP BY 1"


GAPS = "(SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1000000 AS s FROM {frame})"



def _gap_stats(frame: str) -> str:
    return f"""SELECT count(s) AS n, {r('avg(s)')} AS mean, {r('stddev_samp(s)')} AS sd, {r('min(s)')} AS min, {r('quantile_cont(s, 0.25)')} AS p25,
      {r('quantile_cont(s, 0.5)')} AS p50, {r('quantile_cont(s, 0.75)')} AS p75, {r('max(s)')} AS max, min(s) = max(s) AS even
      FROM {GAPS.replace('{frame}', frame)}"""


def _rolling(days: int, column: str, frame: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    extra = f"{by}, " if by else ""
    return f"""SELECT event_id, {extra}ts, {column}, {r(f'avg({column}) OVER ({part}ORDER BY epoch_us(ts) RANGE BETWEEN {days * DAY - 1} PRECEDING AND CURRENT ROW)')}
      AS rolling_mean FROM {frame}"""


def _corr(frame: str, cols, full: bool = True) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if full or i < j]
    return union_all(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n,
        {r(f'CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END')} AS r FROM {frame}""" for a, b in pairs)


def _spearman(frame: str, cols) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return union_all(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, {r('corr(x, y)')} AS r FROM (SELECT {rank.format(a)} AS x, {rank.format(b)} AS y
        FROM {frame} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for i, a in enumerate(cols) for b in cols[i + 1:])


def _significance(inner: str) -> str:
    return f"SELECT col_a, col_b, n, r, {r('r0 * sqrt((n - 2) / (1 - r0 * r0))', 4)} AS t FROM ({inner})"


def _pairs(frame: str, cols) -> str:
    return union_all(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, {r(f'corr({a}, {b})')} AS r, corr({a}, {b}) AS r0 FROM {frame}"""
        for i, a in enumerate(cols) for b in cols[i + 1:])


def _ranks(frame: str, group: str, value: str) -> str:
    return f"""(SELECT {group} AS g, {value} AS v, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0::DOUBLE AS k
      FROM {frame} WHERE {group} IS NOT NULL AND {value} IS NOT NULL)"""


def _ties(frame: str, group: str, value: str) -> str:
    return f"""(SELECT sum(t::DOUBLE * t * t - t) AS ties FROM (SELECT count(*) AS t FROM {frame} WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY {value}))"""


def _mann_whitney(frame: str, group: str, value: str, first: str) -> str:
    base = f"""SELECT count(*) FILTER (g = '{first}') AS n1, count(*) FILTER (g <> '{first}') AS n2, sum(k) FILTER (g = '{first}') AS r1
      FROM {_ranks(frame, group, value)}"""
    u = f"SELECT n1, n2, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u1 FROM ({base})"
    return f"""SELECT n1, n2, {r('u1', 2)} AS u1, {r('(greatest(u1, nn - u1) - nn / 2 - 0.5) / sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1))))')} AS z
      FROM ({u}), {_ties(frame, group, value)}"""


def _kruskal(frame: str, group: str, value: str) -> str:
    base = f"SELECT count(*) AS groups, sum(n)::BIGINT AS n, sum(rs * rs / n) AS q FROM (SELECT g, count(*) AS n, sum(k) AS rs FROM {_ranks(frame, group, value)} GROUP BY g)"
    return f"""SELECT groups, n, (12 / (n::DOUBLE * (n + 1)) * q - 3 * (n::DOUBLE + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h
      FROM ({base}), {_ties(frame, group, value)}"""


GROUP_STATS = f"count({{v}}) AS n, {r('avg({v})')} AS mean, {r('stddev_samp({v})')} AS sd"


def _fences(frame: str, cols) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", {r('lo')} AS lo, {r('hi')} AS hi, (SELECT count(*) FROM {frame} WHERE {c} < lo OR {c} > hi) AS n_iqr FROM
        (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {frame}))"""
        for c in cols)


def _zcounts(frame: str, cols) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", (SELECT count(*) FROM {frame} WHERE abs(({c} - m) / s) > 3) AS n_z FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {frame})"""
        for c in cols)


def _zrows(frame: str, cols, cut: float = 3) -> str:
    centres = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(cols))
    worst = "greatest(" + ", ".join(f"abs(({c} - m{i}) / s{i})" for i, c in enumerate(cols)) + ")"
    return f"SELECT {frame}.*, {r(worst)} AS max_z FROM {frame}, (SELECT {centres} FROM {frame}) WHERE {worst} > {cut}"


RULES = {"tax_above_discount": "l_tax > l_discount", "free_item": "l_discount >= 0.1 AND l_quantity > 45", "no_price": "l_extendedprice <= 0"}
SPAN = "least({k} - 1, CAST(floor(({c} - lo) / ((hi - lo) / {k})) AS INTEGER))"


PART_NUMBERS, PART_TEXT = ("p_partkey", "p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")
FEATURE_SQL = " UNION ALL ".join([
    *[f"""SELECT '{c}' AS "column", CASE WHEN skewness({c}) > 1 AND min({c}) > 0 THEN 'log' WHEN skewness({c}) > 1 THEN 'sqrt' ELSE 'reflect' END AS feature,
      CASE WHEN skewness({c}) > 1 THEN 'skewed right' ELSE 'skewed left' END AS reason FROM part HAVING skewness({c}) > 1 AND min({c}) >= 0 OR skewness({c}) < -1"""
      for c in PART_NUMBERS],
    *[f"SELECT '{c}', 'binning', 'continuous, ' || count(DISTINCT {c}) || ' distinct values' FROM part HAVING count(DISTINCT {c}) > 20" for c in PART_NUMBERS],
    f"SELECT col_a, 'ratio and difference with ' || col_b, 'correlation ' || round(r, 4) FROM ({_corr('part', PART_NUMBERS, False)}) WHERE abs(r) > 0.7",
    *[f"""SELECT '{c}', CASE WHEN count(DISTINCT {c}) < 10 THEN 'one_hot' ELSE 'target_or_frequency' END, count(DISTINCT {c}) || ' distinct values' FROM part"""
      for c in PART_TEXT],
])

QUERIES: dict[str, Entry] = {
    # time
    "date_range": (on("orders", M.date_range), """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min, max(o_orderdate) AS max,
      count(*) - count(o_orderdate) AS nulls FROM orders"""),
    "counts_by_year": (on("orders", lambda d: M.counts_by_year(d, "o_orderdate")), _per("year(o_orderdate)", "o_orderdate", "orders")),
    "counts_by_month": (on("orders", lambda d: M.counts_by_month(d, "o_orderdate")), _per("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "o_orderdate", "orders")),
    "counts_by_week": (on("orders", lambda d: M.counts_by_week(d, "o_orderdate")), _per("CAST(date_trunc('week', o_orderdate) AS TIMESTAMP)", "o_orderdate", "orders")),
    "counts_by_weekday": (on("events", lambda d: M.counts_by_weekday(d, "ts")), _per("isodow(ts) - 1", "ts", "events")),
    "counts_by_month_of_year": (on("orders", lambda d: M.counts_by_month_of_year(d, "o_orderdate")), _per("month(o_orderdate)", "o_orderdate", "orders")),
    "gap_stats": (on("events", lambda d: M.gap_stats(d, "ts"), 4), _gap_stats("events").replace(", 6)", ", 4)")),
    "gap_stats_equal_times": (lambda s, d: rounded(M.gap_stats(table(s, d, "lineitem"), "l_shipdate"), 4), _gap_stats("(SELECT l_shipdate AS ts FROM lineitem)").replace(", 6)", ", 4)")),
    "gap_list": (on("events", lambda d: M.gap_list(d, "ts"), 4), f"""SELECT prev AS start, ts AS "end", {r('s', 4)} AS seconds FROM {GAPS.replace('{frame}', 'events')}
      WHERE s > 5 * (SELECT quantile_cont(s, 0.5) FROM {GAPS.replace('{frame}', 'events')})"""),
    "rolling_mean_30d": (on("events", lambda d: M.rolling_mean(d, "ts", "value", ["event_id"])), _rolling(30, "value", "events")),
    "rolling_mean_7d": (lambda s, d: rounded(M.rolling_mean(FR.holes(s, d), "ts", "seen", ["event_id"], days=7)), _rolling(7, "seen", FR.HOLES_SQL)),
    "rolling_mean_by_key": (on("events", lambda d: M.rolling_mean(d, "ts", "value", ["event_id"], ["user_id"], 3)), _rolling(3, "value", "events", "user_id")),
    "monthly_mean": (on("orders", lambda d: M.monthly_mean(d, "o_orderdate", "o_totalprice"), 4),
                     f"SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n, {r('avg(o_totalprice)', 4)} AS mean FROM orders GROUP BY 1"),
    "trend_line": (on("events", lambda d: M.trend_line(d, "ts", "value"), 4), f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(*) AS n,
      {r('sum(value)', 4)} AS total, {r('avg(value)', 4)} AS mean FROM events GROUP BY 1"""),
    "trend_lines": (on("orders", lambda d: M.trend_lines(d, "o_orderdate", grain="month"), 4), union_all(f"""SELECT '{c}' AS "column", CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period,
      count({c}) AS n, {r(f'sum({c})::DOUBLE', 4)} AS total, {r(f'avg({c})', 4)} AS mean FROM orders GROUP BY 2""" for c in ORDER_NUMBERS)),
    "rolling_trend": (on("orders", lambda d: M.rolling_trend(d, "o_orderdate"), 4), union_all(f"""SELECT '{c}' AS "column", p AS period, n, {r('t / n', 4)} AS mean,
      {r('sum(t) OVER w / sum(n) OVER w', 4)} AS rolling_mean FROM (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS p, count({c}) AS n, sum({c})::DOUBLE AS t FROM orders GROUP BY 1)
      WINDOW w AS (ORDER BY p RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""" for c in ORDER_NUMBERS)),
    "resample": (on("orders", lambda d: M.resample(d, "o_orderdate", "o_totalprice", "day"), 4), f"""SELECT p AS period, count(o_orderkey) AS n, {r('avg(o_totalprice)', 4)} AS mean
      FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS p FROM orders) LEFT JOIN orders ON o_orderdate = p GROUP BY p"""),
    "time_trend": (on("orders", lambda d: M.time_trend(d, "o_orderdate", list(ORDER_NUMBERS)), 4), union_all(
        f"""SELECT '{c}' AS "column", count(*) AS n, {r(f'regr_slope({c}, x)', 4)} AS slope_per_day, {r(f'corr({c}, x)', 4)} AS r, {r(f'regr_r2({c}, x)', 4)} AS r2
        FROM (SELECT *, epoch_us(o_orderdate) / {DAY} AS x FROM orders)""" for c in ORDER_NUMBERS)),
    "autocorrelation": (on("events", lambda d: M.autocorrelation(d, "value", "ts", "event_id", 24, block=4096)), f"""
      WITH v AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value - avg(value) OVER () AS x FROM events),
      c AS (SELECT sum(x * x) AS c0, count(*) AS n FROM v)
      SELECT CAST(h AS INTEGER) AS lag, any_value(n) AS n, {r('sum(a.x * b.x) / any_value(c0)')} AS r, {r('1.959963984540054 / sqrt(any_value(n))')} AS band95,
      {r('2.5758293035489004 / sqrt(any_value(n))')} AS band99 FROM (SELECT unnest(range(25)) AS h), v a JOIN v b ON b.i = a.i + h, c GROUP BY h"""),
    "autocorrelation_all": (on("events", lambda d: M.autocorrelation(d, "value", "ts", "event_id")), f"""
      WITH v AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value - avg(value) OVER () AS x FROM events),
      c AS (SELECT sum(x * x) AS c0, count(*) AS n FROM v),
      s AS (SELECT b.i - a.i AS lag, sum(a.x * b.x) AS s FROM v a JOIN v b ON b.i >= a.i GROUP BY 1)
      SELECT lag, n, {r('s / c0')} + 0.0::DOUBLE AS r, {r('1.959963984540054 / sqrt(n)')} AS band95, {r('2.5758293035489004 / sqrt(n)')} AS band99 FROM s, c"""),
    # relations
    "corr_matrix": (on("lineitem", L.corr_matrix), _corr("lineitem", LINE_NUMBERS)),
    "corr_matrix_missing": (lambda s, d: rounded(L.corr_matrix(FR.holes(s, d).join(
        table(s, d, "labels").select(F.col("doc_id").alias("event_id"), "quality"), "event_id", "left"))),
        _corr(f"(SELECT h.*, l.quality FROM {FR.HOLES_SQL} h LEFT JOIN labels l ON l.doc_id = h.event_id)", ("event_id", "user_id", "value", "seen", "quality"))),
    "corr_constant_column": (lambda s, d: rounded(L.corr_matrix(FR.constants(s, d), ["l_quantity", "const_col", "l_tax"])), _corr(FR.CONST_SQL, ("l_quantity", "const_col", "l_tax"))),
    "strong_pairs": (lambda s, d: rounded(L.strong_pairs(FR.sizes(s, d))),
                     f"SELECT * FROM ({_corr(FR.SIZES_SQL, ('doc_id', 'n_chars', 'text_chars', 'lang_chars'), False)}) WHERE abs(r) > 0.7"),
    "spearman_matrix": (on("lineitem", L.spearman_matrix), _spearman("lineitem", LINE_NUMBERS)),
    "spearman_missing": (lambda s, d: rounded(L.spearman_matrix(FR.labelled(s, d), ["n_chars", "quality", "doc_id"])),
                         _spearman(FR.LABELLED_SQL, ("n_chars", "quality", "doc_id"))),
    "corr_significance": (on("lineitem", lambda d: L.corr_significance(d).select(
        "col_a", "col_b", "n", "r", F.round(F.col("t") + 1e-9, 4).alias("t"))), _significance(_pairs("lineitem", LINE_NUMBERS))),
    "corr_wide": (on("lineitem", L.corr_wide), union_all(
        f"""SELECT '{a}' AS "column", {', '.join(f"{r(f'corr({a}, {b})')} AS {b}" for b in LINE_NUMBERS)} FROM lineitem""" for a in LINE_NUMBERS)),
    "group_describe": (on("lineitem", lambda d: L.group_describe(d, "l_returnflag", "l_extendedprice"), 4), f"""SELECT l_returnflag AS "group",
      {GROUP_STATS.replace('{v}', 'l_extendedprice')}, {r('min(l_extendedprice)')} AS min, {r('quantile_cont(l_extendedprice, 0.25)')} AS p25,
      {r('quantile_cont(l_extendedprice, 0.5)')} AS median, {r('quantile_cont(l_extendedprice, 0.75)')} AS p75, {r('max(l_extendedprice)')} AS max
      FROM lineitem GROUP BY 1""".replace(", 6)", ", 4)")),
    "group_agg": (on("lineitem", lambda d: L.group_agg(d, "l_suppkey", "l_quantity")), f"""SELECT l_suppkey AS "group", {GROUP_STATS.replace('{v}', 'l_quantity')},
      {r('quantile_cont(l_quantity, 0.5)')} AS median FROM lineitem GROUP BY 1"""),
    "all_group_stats": (on("lineitem", L.all_group_stats, 4), union_all(f"""SELECT '{g}' AS category, {g} AS value, '{c}' AS "column", {GROUP_STATS.replace('{v}', c)},
      min({c})::DOUBLE AS min, {r(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS p25, {r(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS median, {r(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS p75,
      max({c})::DOUBLE AS max FROM lineitem GROUP BY {g}""".replace(", 6)", ", 4)").replace(f"min({c})::DOUBLE", r(f"min({c})::DOUBLE", 4)).replace(f"max({c})::DOUBLE", r(f"max({c})::DOUBLE", 4))
      for g in LINE_GROUPS for c in LINE_NUMBERS)),
    "all_group_stats_missing": (lambda s, d: rounded(L.all_group_stats(FR.labelled(s, d), ["lang", "source"], ["quality", "n_chars"]).select("category", "value", "column", "n", "mean", "median")),
      union_all(f"""SELECT '{g}' AS category, {g} AS value, '{c}' AS "column", count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median
      FROM {FR.LABELLED_SQL} WHERE {g} IS NOT NULL AND {c} IS NOT NULL GROUP BY {g}""" for g in ("lang", "source") for c in ("quality", "n_chars"))),
    "scatter_grid": (lambda s, d: L.scatter_grid(FR.sizes(s, d), bins=10), union_all(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {SPAN.format(k=10, c=a)} AS bin_a,
      {SPAN.replace('lo', 'lo2').replace('hi', 'hi2').format(k=10, c=b).replace('flo2or', 'floor')} AS bin_b, count(*) AS n FROM {FR.SIZES_SQL},
      (SELECT min({a}) AS lo, max({a}) AS hi, min({b}) AS lo2, max({b}) AS hi2 FROM {FR.SIZES_SQL}) WHERE (SELECT abs(corr({a}, {b})) FROM {FR.SIZES_SQL}) > 0.7 GROUP BY ALL"""
      for a, b in (("doc_id", "n_chars"), ("doc_id", "text_chars"), ("n_chars", "text_chars")))),
    "cross_group": (on("lineitem", lambda d: L.cross_group(d, "l_returnflag", "l_linestatus", "l_quantity")), f"""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n,
      {r('sum(l_quantity)')} AS total, {r('avg(l_quantity)')} AS mean FROM lineitem GROUP BY ALL"""),
    "scatter_sample": (on("part", lambda d: L.scatter_sample(d, "p_size", "p_retailprice", "p_partkey", 200)), None),
    "scatter_bins": (on("part", lambda d: L.scatter_bins(d, "p_size", "p_retailprice", 10)), f"""SELECT {SPAN.format(k=10, c='p_size')} AS bin_a,
      {SPAN.replace('lo', 'lo2').replace('hi', 'hi2').format(k=10, c='p_retailprice').replace('flo2or', 'floor')} AS bin_b, count(*) AS n
      FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS lo2, max(p_retailprice) AS hi2 FROM part) GROUP BY ALL"""),
    # tests
    "normality_test": (on("lineitem", T.normality_test, 4), f"""SELECT "column", CAST(n AS BIGINT) AS n, {r('z1', 4)} AS z_skew, {r('z2', 4)} AS z_kurt, {r('z1 * z1 + z2 * z2', 4)} AS k2,
      {r('exp(-(z1 * z1 + z2 * z2) / 2)', 4)} AS p, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS normal FROM ({_k2('lineitem', LINE_NUMBERS)})"""),
    "mann_whitney": (on("lineitem", lambda d: T.mann_whitney(d, "l_linestatus", "l_quantity").drop("p").withColumn("u1", F.round("u1", 2))),
                     _mann_whitney("lineitem", "l_linestatus", "l_quantity", "F")),
    "kruskal_wallis": (on("lineitem", lambda d: T.kruskal_wallis(d, "l_returnflag", "l_quantity")),
                       f"SELECT groups, n, {r('h')} AS h, groups - 1 AS df, {r('exp(-h / 2)')} AS p FROM ({_kruskal('lineitem', 'l_returnflag', 'l_quantity')})"),
    "all_group_tests": (on("lineitem", lambda d: T.all_group_tests(d).drop("p")), union_all(f"""SELECT '{g}' AS category, '{c}' AS "column", groups, n, {r('h')} AS h, groups - 1 AS df
      FROM ({_kruskal('lineitem', g, c)})""" for g in LINE_GROUPS for c in LINE_NUMBERS)),
    "all_group_tests_missing": (lambda s, d: rounded(T.all_group_tests(FR.holes(s, d), ["event_type"], ["value", "seen"]).drop("p")), union_all(
      f"""SELECT 'event_type' AS category, '{c}' AS "column", groups, n, {r('h')} AS h, groups - 1 AS df FROM ({_kruskal(FR.HOLES_SQL, 'event_type', c)})""" for c in ("value", "seen"))),
    "group_comparison": (on("orders", lambda d: T.group_comparison(d, "o_orderstatus", "o_totalprice")),
                         f"SELECT 'kruskal_wallis' AS test, groups, n, {r('h')} AS statistic, {r('exp(-h / 2)')} AS p FROM ({_kruskal('orders', 'o_orderstatus', 'o_totalprice')})"),
    "correlation_choice": (on("lineitem", lambda d: T.correlation_choice(d).select(
        "col_a", "col_b", "method", "n", "r")), f"SELECT col_a, col_b, 'spearman' AS method, n, r FROM ({_spearman('lineitem', LINE_NUMBERS)})"),
    # outliers
    "iqr_outlier_counts": (on("events", A.iqr_outlier_counts), _fences("events", ("event_id", "user_id", "value"))),
    "iqr_outlier_rows": (on("events", lambda d: A.iqr_outlier_rows(d, "value"), 2), """SELECT event_id, ts, user_id, event_type, round(value, 2) AS value, props FROM events,
      (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"""),
    "zscore_outlier_counts": (on("events", A.zscore_outlier_counts), _zcounts("events", ("event_id", "user_id", "value"))),
    "zscore_row_flags": (on("events", A.zscore_row_flags), _zrows("events", ("event_id", "user_id", "value"))),
    "isolation_forest_share": (lambda s, d: isolation_forest(table(s, d, "events"), ["event_id"]).agg(
        F.count("*").alias("rows"), (F.abs(F.avg(F.col("is_outlier").cast("int")) - 0.05) < 0.005).alias("share_ok"),
        F.min(F.col("score").between(0, 1)).alias("scores_ok")), "SELECT count(*) AS rows, true AS share_ok, true AS scores_ok FROM events"),
    "isolation_forest": (on("lineitem", lambda d: isolation_forest(d, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])), None),
    "rule_violations": (on("lineitem", lambda d: A.rule_violations(d, RULES)), union_all(
        f"SELECT '{n}' AS rule, count(*) AS n FROM lineitem WHERE {p}" for n, p in RULES.items())),
    "violating_rows": (on("lineitem", lambda d: A.violating_rows(d, RULES).select("l_orderkey", "l_linenumber", "l_tax", F.array_join("rules", ",").alias("rules")), 2), """
      SELECT l_orderkey, l_linenumber, round(l_tax, 2) AS l_tax, concat_ws(',', """ + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in RULES.items()) + ") AS rules FROM lineitem WHERE "
      + " OR ".join(f"({p})" for p in RULES.values())),
    "rule_negative_values": (on("customer", lambda d: A.rule_violations(d, A.mostly_positive_rules(d, 0.2))),
                             "SELECT 'negative_c_acctbal' AS rule, count(*) AS n FROM customer WHERE c_acctbal < 0"),
    "outlier_ranking": (on("events", A.outlier_ranking), f"""SELECT * FROM ({_fences('events', ('event_id', 'user_id', 'value'))}) JOIN
      ({_zcounts('events', ('event_id', 'user_id', 'value'))}) USING ("column")"""),
    # features
    "log_candidates": (on("events", E.log_candidates), union_all(f"""SELECT '{c}' AS "column", {r(f'skewness({c})')} AS skew, {r(f'min({c})')} AS min,
      CASE WHEN skewness({c}) > 1 AND min({c}) > 0 THEN 'log' WHEN skewness({c}) > 1 AND min({c}) >= 0 THEN 'sqrt' WHEN skewness({c}) < -1 THEN 'reflect' ELSE 'none' END AS transform,
      CASE WHEN abs(skewness({c})) <= 1 THEN 'not skewed' WHEN skewness({c}) > 1 AND min({c}) < 0 THEN 'skewed right with negative values' WHEN skewness({c}) > 1 THEN 'skewed right'
      ELSE 'skewed left' END AS reason FROM events""" for c in ("event_id", "user_id", "value")).replace("min(event_id)", "min(event_id)::DOUBLE").replace("min(user_id)", "min(user_id)::DOUBLE")),
    "transform_skewed": (on("customer", lambda d: E.transform_skewed(d.select("c_custkey", "c_acctbal"), ["c_acctbal"])), f"""SELECT c_custkey, c_acctbal,
      CASE WHEN c_acctbal > 0 THEN {r('ln(c_acctbal)')} END AS c_acctbal_log, CASE WHEN c_acctbal > -1 THEN {r('ln(1 + c_acctbal)')} END AS c_acctbal_log1p,
      CASE WHEN c_acctbal >= 0 THEN {r('sqrt(c_acctbal)')} END AS c_acctbal_sqrt FROM customer"""),
    "reflect_transform": (on("part", lambda d: E.reflect_transform(d.select("p_partkey", "p_retailprice"), "p_retailprice")),
                          f"SELECT p_partkey, p_retailprice, {r('ln((SELECT max(p_retailprice) FROM part) + 1 - p_retailprice)')} AS p_retailprice_reflect FROM part"),
    "encoding_advice": (on("part", E.encoding_advice), union_all(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS uniques,
      CASE WHEN count(DISTINCT {c}) < 10 THEN 'one_hot' ELSE 'target_or_frequency' END AS encoding FROM part""" for c in ("p_name", "p_brand", "p_type"))),
    "one_hot": (on("orders", lambda d: E.one_hot(d.select("o_orderkey", "o_orderstatus"), "o_orderstatus")), "SELECT o_orderkey, o_orderstatus, " + ", ".join(
        f"CAST(o_orderstatus = '{v}' AS INTEGER) AS o_orderstatus_{v}" for v in "FOP") + " FROM orders"),
    "frequency_encode": (on("part", lambda d: E.frequency_encode(d.select("p_partkey", "p_brand"), "p_brand")),
                         f"SELECT p_partkey, p_brand, {r('count(*) OVER (PARTITION BY p_brand) / count(*) OVER ()')} AS p_brand_freq FROM part"),
    "target_encode": (on("part", lambda d: E.target_encode(d.select("p_partkey", "p_type", "p_retailprice"), "p_type", "p_retailprice", 10), 4), f"""SELECT p_partkey, p_type, p_retailprice,
      {r('(sum(p_retailprice) OVER (PARTITION BY p_type) + 10 * avg(p_retailprice) OVER ()) / (count(*) OVER (PARTITION BY p_type) + 10)', 4)} AS p_type_target FROM part"""),
    "datetime_features": (on("events", lambda d: E.datetime_features(d.select("event_id", "ts"), "ts")), """SELECT event_id, ts, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
      CAST(isodow(ts) - 1 AS INTEGER) AS ts_day_of_week, CAST(hour(ts) AS INTEGER) AS ts_hour, isodow(ts) >= 6 AS ts_is_weekend FROM events"""),
    "bin_equal_width": (on("orders", lambda d: E.bin_equal_width(d.select("o_orderkey", "o_totalprice"), "o_totalprice", 8), 2), f"""SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice,
      {SPAN.format(k=8, c='o_totalprice')} AS o_totalprice_bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"""),
    "bin_quantile": (on("orders", lambda d: E.bin_quantile(d.select("o_orderkey", "o_totalprice"), "o_totalprice", 4), 2), """SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice,
      CAST(o_totalprice > q[1] AS INTEGER) + CAST(o_totalprice > q[2] AS INTEGER) + CAST(o_totalprice > q[3] AS INTEGER) AS o_totalprice_qbin
      FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)"""),
    "interaction_features": (lambda s, d: rounded(E.interaction_features(FR.sizes(s, d))), f"""SELECT doc_id, n_chars, text_chars, lang_chars,
      {r('n_chars::DOUBLE / nullif(text_chars, 0)')} AS n_chars_per_text_chars, (n_chars - text_chars)::DOUBLE AS n_chars_minus_text_chars FROM {FR.SIZES_SQL}"""),
    "feature_advice": (on("part", E.feature_advice), FEATURE_SQL),
}
