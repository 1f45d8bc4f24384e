"""Overview, numeric, categorical and missing-value queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import QUANTILES
from ..operators import categorical as C, missing as W, numeric as U, overview as O
from ..operators.timeseries import counts_by_year
from . import frames as FR
from .common import LINE_NUMBERS, Entry, on, r, rounded, table, union_all

LINE = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
        ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
        ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
WHOLE = tuple(c for c, t in LINE if t in ("bigint", "int"))
KIND = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical", "timestamp_ntz": "datetime"}
LABELLED = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]
DUP = ("l_quantity", "l_discount", "l_tax", "l_returnflag")


def _nulls(frame: str, cols) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, {r(f'(count(*) - count({c})) / count(*)')} AS null_share FROM {frame}"""
        for c in cols)


def _moments(frame: str, cols, body: str) -> str:
    return union_all(f"""SELECT '{c}' AS "column", {body.replace('{c}', f'CAST({c} AS DOUBLE)')} FROM {frame}""" for c in cols)


def _quartiles(c: str) -> tuple[str, str, str]:
    return f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.5)", f"quantile_cont({c}, 0.75)"


DESCRIBE = (
    f"count({{c}}) AS n, {r('avg({c})')} AS mean, {r('stddev_samp({c})')} AS sd, {r('min({c})')} AS min, "
    f"{r('quantile_cont({c}, 0.25)')} AS p25, {r('quantile_cont({c}, 0.5)')} AS p50, {r('quantile_cont({c}, 0.75)')} AS p75, {r('max({c})')} AS max"
)
NO_NUMBERS = ", ".join(f"CAST(NULL AS DOUBLE) AS {a}" for a in ("mean", "sd", "min", "p25", "p50", "p75", "max"))


def _describe_all() -> str:
    parts, no_times = [], "CAST(NULL AS TIMESTAMP) AS first, CAST(NULL AS TIMESTAMP) AS last"
    for c, kind in LINE:
        best = f"(SELECT {{}} FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        if KIND[kind] == "numeric":
            body = DESCRIBE.replace("{c}", f"CAST({c} AS DOUBLE)").split(" AS n, ", 1)[1]
            parts.append(f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS uniques, CAST(NULL AS VARCHAR) AS top,
              CAST(NULL AS BIGINT) AS freq, {no_times}, {body} FROM lineitem""")
        else:
            times = no_times if KIND[kind] == "categorical" else f"CAST(min({c}) AS TIMESTAMP) AS first, CAST(max({c}) AS TIMESTAMP) AS last"
            parts.append(f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS uniques, CAST({best.format(c)} AS VARCHAR) AS top,
              {best.format('count(*)')} AS freq, {times}, {NO_NUMBERS} FROM lineitem""")
    return union_all(parts)


def _constant() -> str:
    cols = [c for c, _ in LINE] + ["const_col", "near_const"]
    parts = union_all(
        f"SELECT '{c}' AS \"column\", count(*) AS uniques, max(k) / sum(k) AS top_share FROM (SELECT {c}, count(*) AS k FROM {FR.CONST_SQL} GROUP BY {c})"
        for c in cols)
    return f"""SELECT "column", uniques, {r('top_share')} AS top_share, CASE WHEN uniques <= 1 THEN 'constant' ELSE 'near_constant' END AS class
      FROM ({parts}) WHERE uniques <= 1 OR top_share >= 0.99"""


def _histogram(c: str, frame: str, k: int) -> str:
    return f"""SELECT '{c}' AS "column", CAST(b AS INTEGER) AS bin, {r(f'lo + b * (hi - lo) / {k}')} AS lo,
      {r(f'CASE WHEN b = {k - 1} THEN hi ELSE lo + (b + 1) * (hi - lo) / {k} END')} AS hi,
      (SELECT count(*) FROM {frame} WHERE least({k - 1}, CAST(floor(({c} - lo) / ((hi - lo) / {k})) AS BIGINT)) = b) AS n
      FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {frame}), (SELECT unnest(range({k})) AS b)"""


def _boxplot(c: str, frame: str) -> str:
    q1, q2, q3 = _quartiles(c)
    return f"""SELECT '{c}' AS "column", {r('p25')} AS p25, {r('p50')} AS p50, {r('p75')} AS p75,
      {r(f'(SELECT min({c}) FROM {frame} WHERE {c} >= p25 - 1.5 * (p75 - p25))')} AS whisker_lo,
      {r(f'(SELECT max({c}) FROM {frame} WHERE {c} <= p75 + 1.5 * (p75 - p25))')} AS whisker_hi,
      (SELECT count(*) FROM {frame} WHERE {c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)) AS fliers
      FROM (SELECT {q1} AS p25, {q2} AS p50, {q3} AS p75 FROM {frame})"""


def _k2(frame: str, cols) -> str:
    """z_skew and z_kurt of the normality test from DuckDB's adjusted skewness and population kurtosis."""
    base = union_all(
        f"""SELECT '{c}' AS "column", count({c})::DOUBLE AS n, skewness({c}) AS sk, kurtosis({c}) AS ku,
        skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS g, kurtosis_pop({c}) + 3 AS b FROM {frame}"""
        for c in cols)
    one = f"""SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
      (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM ({base})"""
    two = f"SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM ({one})"
    three = f"SELECT *, y / sqrt(2 / (w2 - 1)) AS q, 1 / sqrt(0.5 * ln(w2)) AS delta, 1 + x * sqrt(2 / (a - 4)) AS d FROM ({two})"
    return f"""SELECT *, delta * ln(q + sqrt(q * q + 1)) AS z1,
      (1 - 2 / (9 * a) - sign(d) * pow((1 - 2 / a) / abs(d), 1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)) AS z2 FROM ({three})"""


def _top_counts(frame: str, cols, n: int = 15) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {frame} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {n}"""
        for c in cols)


PART_TEXT = ("p_name", "p_brand", "p_type")
CLASS_CASE = "CASE WHEN u <= 1 THEN 'constant' WHEN u = 2 THEN 'binary' WHEN u = k THEN 'id_like' WHEN u <= 20 THEN 'low' ELSE 'high' END"

def _lineage(spark, sf: str):
    """The columns behind three results that do not name them in their rows."""
    lines = table(spark, sf, "lineitem")
    results = {
        "prices": lines.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total")),
        "rules": lines.where("l_tax > l_discount AND l_extendedprice > 0").agg(F.count("*").alias("n")), "years": counts_by_year(lines, "l_shipdate"),
    }
    return O.column_coverage(lines, results, {name: O.lineage(lines, result) for name, result in results.items()})


QUERIES: dict[str, Entry] = {
    "dataset_shape": (on("lineitem", O.dataset_shape), "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem"),
    "column_types": (on("lineitem", O.column_info), union_all(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{t}' AS type, count({c}) AS n FROM lineitem""" for i, (c, t) in enumerate(LINE))),
    "minimal_schema": (on("customer", lambda d: O.minimal_schema(d, ["c_custkey"])), """
      SELECT 'shape' AS part, 'rows' AS item, CAST(count(*) AS VARCHAR) AS text FROM customer UNION ALL SELECT 'shape', 'columns', '5'
      UNION ALL SELECT 'type', c, t FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'),
        ('c_mktsegment', 'string')) v(c, t)
      UNION ALL SELECT 'row', '', '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' ||
        c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)"""),
    "column_classes": (on("lineitem", O.column_classes), union_all(
        f"""SELECT '{c}' AS "column", '{KIND[t]}' AS class, count({c}) AS n FROM lineitem""" for c, t in LINE)),
    "select_class": (on("orders", O.select_class, 2), "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders"),
    "total_nulls": (lambda s, d: O.total_nulls(FR.labelled(s, d)),
                    f"SELECT CAST(2 * count(*) - count(quality) - count(toxic) AS BIGINT) AS nulls FROM {FR.LABELLED_SQL}"),
    "null_counts": (lambda s, d: rounded(O.null_counts(FR.holes(s, d))),
                    _nulls(FR.HOLES_SQL, ("event_id", "ts", "user_id", "event_type", "value", "seen"))),
    "column_overview": (lambda s, d: O.column_overview(FR.labelled(s, d)), union_all(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS uniques FROM {FR.LABELLED_SQL}"""
        for c, t in LABELLED)),
    "duplicate_row_count": (on("lineitem", lambda d: O.duplicate_row_count(d.select(*DUP))),
                            f"SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM (SELECT DISTINCT {', '.join(DUP)} FROM lineitem)"),
    "duplicate_row_count_exact": (on("documents", lambda d: O.duplicate_row_count(d.select("text", "lang"), exact=True)),
                                  "SELECT (SELECT count(*) FROM documents) - count(*) AS duplicates FROM (SELECT DISTINCT text, lang FROM documents)"),
    "duplicate_rows": (on("lineitem", lambda d: O.duplicate_rows(d.select(*DUP))),
                       f"SELECT {', '.join(DUP[:3])}, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "describe_all": (on("lineitem", O.describe_all), _describe_all()),
    "constant_columns": (lambda s, d: rounded(O.constant_columns(FR.constants(s, d))), _constant()),
    "id_like_columns": (on("orders", O.id_like_columns), 'SELECT * FROM (' + union_all(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS uniques FROM orders HAVING count(DISTINCT {c}) = count(*)"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")"),
    "column_lineage": (_lineage, union_all(f"""SELECT '{c}' AS "column", '{a}' AS analyses, CAST({n} AS BIGINT) AS n FROM lineitem HAVING count(*) > 0""" for c, a, n in (
        *[(c, "prices,rules", 2) for c in ("l_extendedprice", "l_discount")], ("l_tax", "rules", 1), ("l_returnflag", "prices", 1), ("l_shipdate", "years", 1),
        *[(c, "", 0) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus")]))),
    "column_coverage": (on("lineitem", lambda d: O.column_coverage(d, {
        "histogram": U.histogram(d), "value_counts": C.value_counts(d), "cardinality": C.cardinality(d)})), union_all(
        f"""SELECT '{c}' AS "column", '{a}' AS analyses, CAST({n} AS BIGINT) AS n FROM lineitem HAVING count({c}) > 0"""
        for c, t in LINE for a, n in [{"numeric": ("cardinality,histogram", 2), "categorical": ("cardinality,value_counts", 2),
                                       "datetime": ("cardinality", 1)}[KIND[t]]])),
    "numeric_describe": (on("lineitem", U.numeric_describe), _moments("lineitem", LINE_NUMBERS, DESCRIBE)),
    "numeric_describe_missing": (lambda s, d: rounded(U.numeric_describe(FR.holes(s, d))),
                                 _moments(FR.HOLES_SQL, ("event_id", "user_id", "value", "seen"), DESCRIBE)),
    "skewness": (on("events", U.skewness), _moments("events", ("event_id", "user_id", "value"), f"count({{c}}) AS n, {r('skewness({c})')} AS skew")),
    "kurtosis": (on("events", U.kurtosis), _moments("events", ("event_id", "user_id", "value"), f"count({{c}}) AS n, {r('kurtosis({c})')} AS kurt")),
    "quantiles": (on("lineitem", U.quantiles), union_all(
        f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS q, {r(f'quantile_cont(CAST({c} AS DOUBLE), {q})')} AS value, true AS exact FROM lineitem"""
        for c in LINE_NUMBERS for q in QUANTILES)),
    "quantiles_sketch": (on("lineitem", lambda d: U.quantiles(d, exact=False)), None),
    "nonpositive_counts": (on("customer", U.nonpositive_counts), union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER ({c} <= 0) AS nonpositive, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM customer"""
        for c in ("c_custkey", "c_nationkey", "c_acctbal"))),
    "shape_flags": (on("events", U.shape_flags), f"""SELECT "column", CAST(n AS BIGINT) AS n, {r('sk')} AS skew, {r('ku')} AS kurt, abs(sk) > 1 AS skewed,
      ku > 3 AS heavy_tailed, CASE WHEN exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AND abs(sk) <= 1 AND ku <= 3 THEN 'pearson' ELSE 'spearman' END AS correlation
      FROM ({_k2('events', ('event_id', 'user_id', 'value'))})"""),
    "histogram": (on("lineitem", lambda d: U.histogram(d, bins=10)), " UNION ALL ".join(_histogram(c, "lineitem", 10) for c in LINE_NUMBERS)),
    "histogram_empty_bins": (on("events", lambda d: U.histogram(d, ["value"], 25)), _histogram("value", "events", 25)),
    "boxplot_stats": (on("events", U.boxplot_stats), " UNION ALL ".join(_boxplot(c, "events") for c in ("event_id", "user_id", "value"))),
    "value_range_check": (on("orders", lambda d: U.value_range_check(d, ["o_totalprice", "o_custkey"])), _moments(
        "orders", ("o_totalprice", "o_custkey"), "round(min({c}), 6) AS min, round(max({c}), 6) AS max")),
    "value_ranges": (on("orders", lambda d: U.value_ranges(d, ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])), union_all(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))),
    "value_counts": (on("part", C.value_counts), _top_counts("part", PART_TEXT)),
    "value_counts_texts": (on("documents", lambda d: C.value_counts(d, top=25)), _top_counts("documents", ("text", "lang", "source"), 25)),
    "value_counts_many": (on("documents", lambda d: C.value_counts(d, ["text"], top=1_500)), _top_counts("documents", ("text",), 1_500)),
    "duplicate_rows_texts": (on("documents", lambda d: O.duplicate_rows(d.select("text", "lang"))), "SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1"),
    "value_counts_numbers": (on("lineitem", lambda d: C.value_counts(d, list(WHOLE), 10)),
                             'SELECT "column", value, n, rank FROM (' + union_all(
        f"""SELECT '{c}' AS "column", value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM
        (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY {c})""" for c in WHOLE) + ") WHERE rank <= 10"),
    "value_shares": (on("orders", C.value_shares), union_all(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, {r(f'count(*) / (SELECT count({c}) FROM orders)')} AS share FROM orders
        WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("o_orderstatus", "o_orderpriority"))),
    "cardinality": (on("lineitem", C.cardinality), union_all(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS uniques FROM lineitem""" for c, _ in LINE)),
    "cardinality_sketch": (on("lineitem", lambda d: C.cardinality(d, rsd=0.02)), None),
    "cardinality_class": (on("customer", C.cardinality_class), union_all(
        f"""SELECT '{c}' AS "column", u AS uniques, {CLASS_CASE} AS class FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS k FROM customer)"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))),
    "top_value": (on("part", C.top_value), 'SELECT "column", value, n FROM (' + _top_counts("part", PART_TEXT, 1) + ")"),
    "category_missing": (lambda s, d: rounded(C.category_missing(FR.labelled(s, d).withColumn("grade", FR.F.col("quality").cast("string")))),
                         _nulls(f"(SELECT text, lang, source, CAST(quality AS VARCHAR) AS grade FROM {FR.LABELLED_SQL})", ("text", "lang", "source", "grade"))),
    "missing_ranking": (lambda s, d: rounded(W.missing_ranking(FR.labelled(s, d))), _nulls(FR.LABELLED_SQL, [c for c, _ in LABELLED])),
    "missing_heatmap": (lambda s, d: rounded(W.missing_heatmap(FR.labelled(s, d), "doc_id", 10)), union_all(
        f"""SELECT CAST(b AS INTEGER) AS bin, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
        {r(f'(count(*) - count({c})) / count(*)')} AS null_share FROM (SELECT *, least(9, CAST(floor((doc_id - lo) / ((hi - lo) / 10)) AS BIGINT)) AS b
        FROM {FR.LABELLED_SQL}, (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents)) GROUP BY b"""
        for c in ("text", "lang", "source", "n_chars", "quality", "toxic"))),
    "missing_heatmap_no_key": (lambda s, d: rounded(W.missing_heatmap(FR.labelled(s, d).select("quality", "toxic", "text"), "quality", 2)), union_all(
        f"""SELECT CAST(CASE WHEN quality >= 0.5 THEN 1 WHEN quality < 0.5 THEN 0 END AS INTEGER) AS bin, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
        {r(f'(count(*) - count({c})) / count(*)')} AS null_share FROM {FR.LABELLED_SQL} GROUP BY 1""" for c in ("toxic", "text"))),
    "high_missing_columns": (lambda s, d: rounded(W.high_missing_columns(FR.labelled(s, d))),
                             f"SELECT * FROM ({_nulls(FR.LABELLED_SQL, [c for c, _ in LABELLED])}) WHERE null_share > 0.2"),
}
