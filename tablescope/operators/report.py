"""The whole profile of a table: steps run in order, findings, and a sectioned report."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..functions.columns import CATEGORICAL, DATETIME, NUMERIC, columns_of, numeric_columns, profiled, small_frame
from ..plans.frequency import distinct_summary
from ..plans.moments import adjusted_kurtosis, adjusted_skew, moments
from ..plans.shared import shared_results
from . import anomalies, categorical, features, hypothesis, missing, numeric, overview, relations, timeseries
from .iforest import isolation_forest
from .logs import RUN_STEPS

Step = tuple[str, Callable[[DataFrame], DataFrame]]

SECTIONS = (
    "overview", "columns", "statistics", "quality", "relations", "anomalies", "features", "recommendations", "next steps",
)


def quality_issues(df: DataFrame) -> DataFrame:
    """(column, issue, n, share): missing values, outliers, constant columns and (column '*') duplicate rows."""
    with shared_results(df):
        return _quality_issues(df)


def _quality_issues(df: DataFrame) -> DataFrame:
    rows = overview.dataset_shape(df).first()["rows"]
    total = F.lit(float(max(rows, 1)))
    parts = [
        overview.null_counts(df, profiled(df)).where("nulls > 0").select(
            "column", F.when(F.col("null_share") > K.HIGH_NULL_SHARE, "high_missing").otherwise("missing").alias("issue"),
            F.col("nulls").alias("n")),
        overview.constant_columns(df).select("column", F.col("class").alias("issue"), F.col("uniques").alias("n")),
        overview.duplicate_row_count(df).where("duplicates > 0").select(
            F.lit("*").alias("column"), F.lit("duplicate_rows").alias("issue"), F.col("duplicates").alias("n")),
    ]
    if numeric_columns(df):
        parts.append(anomalies.iqr_outlier_counts(df).where("n_iqr > 0").select(
            "column", F.lit("outliers").alias("issue"), F.col("n_iqr").alias("n")))
    return reduce(DataFrame.unionByName, parts).select("column", "issue", "n", (F.col("n") / total).alias("share"))


def key_findings(df: DataFrame, top: int = 10, group_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(rank, kind, subject, value, severity): the strongest correlations, skews, outlier shares, gaps in the data, time trends and
    (for the given category and numeric pairs) group differences."""
    with shared_results(df):
        return _key_findings(df, top, group_pairs)


def _key_findings(df: DataFrame, top: int = 10, group_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    named = lambda part, kind, subject, value, severity: part.select(
        F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"), severity.cast("double").alias("severity"))
    parts = [named(
        overview.null_counts(df, profiled(df)).where("nulls > 0"), "missing", F.col("column"), F.col("nulls"), F.col("null_share"))]
    numbers, dates = numeric_columns(df), columns_of(df, DATETIME)
    if numbers:
        parts.append(named(
            numeric.shape_flags(df, numbers).where("skewed"), "skew", F.col("column"), F.col("skew"),
            F.least(F.lit(1.0), F.abs("skew") / 10)))
        counts = anomalies.iqr_outlier_counts(df, numbers).where("n_iqr > 0").join(
            moments(df, numbers).select("column", F.col("n").alias("_n")), "column")
        parts.append(named(counts, "outliers", F.col("column"), F.col("n_iqr"), F.col("n_iqr") / F.col("_n")))
    if len(numbers) > 1:
        parts.append(named(
            relations.strong_pairs(df, numbers), "correlation", F.concat("col_a", F.lit(" / "), "col_b"), F.col("r"), F.abs("r")))
    for ts in dates if numbers else []:
        parts.append(named(
            timeseries.time_trend(df, ts, numbers).where(F.col("r2") > K.TREND_R2), "time_trend",
            F.concat("column", F.lit(f" / {ts}")), F.col("slope_per_day"), F.col("r2")))
    for group, value in group_pairs:
        parts.append(named(
            hypothesis.kruskal_wallis(df, group, value).where("p < 0.05"), "group_difference", F.lit(f"{value} / {group}"),
            F.col("h"), 1 - F.col("p")))
    found = reduce(DataFrame.unionByName, parts).orderBy(F.desc("severity"), "kind", "subject").limit(top)
    ordered = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), "kind", "subject", "value", "severity"))).alias("f"))
    return ordered.select(F.posexplode("f").alias("i", "x")).select((F.col("i") + 1).alias("rank"), "x.kind", "x.subject", "x.value", "x.severity")


def significant(name: str, digits: int = 4) -> Column:
    """A number as text: to ``digits`` decimals, or to as many that a small one keeps that number of digits."""
    x = F.col(name)
    short = F.format_string(f"%.{digits - 1}e", x).cast("double").cast("string")
    return F.when((x != 0) & (F.abs(x) < 10.0 ** (1 - digits)), short).otherwise(F.round(x, digits).cast("string"))


def column_summary(df: DataFrame) -> DataFrame:
    """(column, type, nulls, null_share, uniques, lo, hi, skew, notes): one row per column; lo and hi are texts."""
    with shared_results(df):
        return _column_summary(df)


def _column_summary(df: DataFrame) -> DataFrame:
    cols = profiled(df)
    base = overview.column_types(df).select("column", "type").join(overview.null_counts(df, cols), "column").join(
        distinct_summary(df, cols).select("column", "uniques", "n", "freq"), "column")
    numbers, dates = numeric_columns(df), columns_of(df, DATETIME)
    spans = []
    if numbers:
        spans.append(moments(df, numbers).select(
            "column", significant("min").alias("lo"), significant("max").alias("hi"),
            adjusted_skew(F.col("n"), F.col("g1")).alias("skew")))
    if dates:
        spans.append(timeseries.date_range(df, dates).select(
            "column", F.col("min").cast("string").alias("lo"), F.col("max").cast("string").alias("hi"), F.lit(None).cast("double").alias("skew")))
    span = reduce(DataFrame.unionByName, spans) if spans else small_frame(
        df.sparkSession, [], "column string, lo string, hi string, skew double")
    joined = base.join(span, "column", "left")
    notes = F.concat_ws(
        "; ",
        F.when(F.col("null_share") > K.HIGH_NULL_SHARE, "many missing"),
        F.when(F.col("uniques") <= 1, "constant").when(F.try_divide("freq", "n") >= K.NEAR_CONSTANT_SHARE, "near constant")
        .when(F.col("uniques") == 2, "binary").when((F.col("uniques") == F.col("n")) & (F.col("nulls") == 0), "unique per row"),
        F.when(F.abs("skew") > K.SKEW_CUT, "skewed"),
    )
    return joined.select("column", "type", "nulls", "null_share", "uniques", "lo", "hi", "skew", notes.alias("notes"))


def insights(df: DataFrame) -> DataFrame:
    """(section, position, text): the report as rows, every text built from computed numbers."""
    with shared_results(df):
        return _insights(df)


def _insights(df: DataFrame) -> DataFrame:
    shown = lambda c, digits=4: F.coalesce(F.round(F.col(c), digits).cast("string"), F.lit("n/a"))
    parts: list[DataFrame] = []

    def add(number: int, rows: DataFrame, order: Column, *words) -> None:
        text = F.concat(*[w if not isinstance(w, str) else F.lit(w) for w in words])
        parts.append(rows.select(F.lit(number).alias("number"), order.cast("string").alias("key"), text.alias("text")))

    column, numbers = F.col("column"), numeric_columns(df)
    add(1, overview.dataset_shape(df), F.lit("0"), F.col("rows").cast("string"), " rows, ", F.col("columns").cast("string"), " columns")
    add(1, overview.total_nulls(df), F.lit("1"), F.col("nulls").cast("string"), " missing cells")
    add(2, column_summary(df), column, column, " (", F.col("type"), "): ", F.col("uniques").cast("string"), " distinct, ",
        F.col("nulls").cast("string"), " missing", F.when(F.col("lo").isNotNull(), F.concat(F.lit(", from "), "lo", F.lit(" to "), "hi")).otherwise(""),
        F.when(F.col("notes") != "", F.concat(F.lit("; "), "notes")).otherwise(""))
    if numbers:
        stats = moments(df, numbers).select(
            "column", "mean", "sd", adjusted_skew(F.col("n"), F.col("g1")).alias("skew"), adjusted_kurtosis(F.col("n"), F.col("g2")).alias("kurt"))
        add(3, stats, column, column, ": mean ", shown("mean"), ", sd ", shown("sd"), ", skew ", shown("skew"), ", excess kurtosis ", shown("kurt"))
        add(6, anomalies.outlier_ranking(df, numbers).where("n_iqr > 0 or n_z > 0"), column, column, ": ", F.col("n_iqr").cast("string"),
            " values outside the fences, ", F.col("n_z").cast("string"), " with |z| above 3")
        add(3, hypothesis.normality_test(df, numbers), F.concat(column, F.lit(" normality")), column, ": ",
            F.when(F.col("normal"), "normal").otherwise("not normal"), " (p = ", shown("p"), ", n = ", F.col("n").cast("string"), ")")
        flagged = anomalies.zscore_row_flags(df, numbers).agg(F.count("*").alias("n"))
        add(6, flagged, F.lit("~ rows by z"), F.col("n").cast("string"), " rows with a |z| above 3 in any column")
        add(6, forest_outliers(df).agg(F.count("*").alias("n")), F.lit("~ rows by forest"), F.col("n").cast("string"), " rows flagged by the isolation forest")
    issues = quality_issues(df)
    add(4, issues, F.concat("column", "issue"), column, ": ", F.col("issue"), " (", F.col("n").cast("string"), ")")
    if len(numbers) > 1:
        add(5, relations.strong_pairs(df, numbers), F.concat("col_a", F.lit("/"), "col_b"), F.col("col_a"), " and ", F.col("col_b"), ": r = ", shown("r"))
        add(5, hypothesis.correlation_choice(df, numbers), F.concat("col_a", F.lit("/"), "col_b", F.lit(" test")), F.col("col_a"), " and ", F.col("col_b"), ": ",
            F.col("method"), " r = ", shown("r"), ", p = ", shown("p"), ", n = ", F.col("n").cast("string"))
    if numbers and columns_of(df, CATEGORICAL):
        add(5, hypothesis.all_group_tests(df), F.concat("column", F.lit(" by "), "category"), column, " by ", F.col("category"), ": ", F.col("groups").cast("string"),
            " groups, H = ", shown("h"), ", p = ", shown("p"))
    advice = features.feature_advice(df)
    add(7, advice, F.concat("column", "feature"), column, ": ", F.col("feature"), " (", F.col("reason"), ")")
    action = (
        F.when(F.col("issue") == "high_missing", "drop or impute").when(F.col("issue") == "missing", "impute")
        .when(F.col("issue").isin("constant", "near_constant"), "drop").when(F.col("issue") == "duplicate_rows", "remove duplicate rows")
        .otherwise("check or cap outliers")
    )
    add(8, issues, F.concat("column", "issue"), action, ": ", column)
    add(9, advice.groupBy("feature").agg(F.count("*").alias("n")).where("feature not like 'ratio%'"), F.col("feature"),
        "apply ", F.col("feature"), " to ", F.col("n").cast("string"), " columns")
    rows = reduce(DataFrame.unionByName, parts)
    # one section at a time: its rows depend on the number of columns only
    listed = rows.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("t"))
    sections = small_frame(df.sparkSession, list(enumerate(SECTIONS, 1)), "number int, section string")
    nothing = F.array(F.struct(F.lit("").alias("key"), F.lit("nothing found").alias("text")))
    return sections.join(listed, "number", "left").select(
        "number", "section", F.posexplode(F.coalesce("t", nothing)).alias("i", "x")
    ).select("section", (F.col("number") * 1_000_000 + F.col("i")).alias("position"), "x.text")


def default_steps(df: DataFrame) -> list[Step]:
    """The analyses of a full run that fit the column classes of the table."""
    numbers, text, dates = (columns_of(df, k) for k in (NUMERIC, CATEGORICAL, DATETIME))
    steps: list[Step] = [
        ("dataset_shape", overview.dataset_shape), ("column_overview", overview.column_overview), ("describe_all", overview.describe_all),
        ("duplicate_row_count", overview.duplicate_row_count), ("duplicate_rows", overview.duplicate_rows),
        ("missing_ranking", missing.missing_ranking), ("constant_columns", overview.constant_columns), ("id_like_columns", overview.id_like_columns),
    ]
    if numbers:
        steps += [
            ("numeric_describe", numeric.numeric_describe), ("shape_flags", numeric.shape_flags), ("histogram", numeric.histogram),
            ("boxplot_stats", numeric.boxplot_stats), ("normality_test", hypothesis.normality_test),
            ("missing_heatmap", lambda d: missing.missing_heatmap(d, numbers[0])),
            ("outlier_ranking", anomalies.outlier_ranking), ("zscore_row_flags", anomalies.zscore_row_flags), ("isolation_forest", forest_outliers),
            ("log_candidates", features.log_candidates),
        ]
    if len(numbers) > 1:
        steps += [
            ("corr_matrix", relations.corr_matrix), ("corr_significance", relations.corr_significance),
            ("correlation_choice", hypothesis.correlation_choice), ("strong_pairs", relations.strong_pairs), ("scatter_grid", relations.scatter_grid),
        ]
    if text:
        steps += [
            ("value_counts", categorical.value_counts), ("cardinality_class", categorical.cardinality_class), ("category_missing", categorical.category_missing)]
    if text and numbers:
        steps += [("all_group_stats", relations.all_group_stats), ("all_group_tests", hypothesis.all_group_tests)]
    for ts in dates:
        steps += [
            (f"{name}_{ts}", lambda d, ts=ts, f=f: f(d, ts)) for name, f in (
                ("date_range", lambda d, ts: timeseries.date_range(d, [ts])), ("counts_by_year", timeseries.counts_by_year),
                ("counts_by_month", timeseries.counts_by_month), ("counts_by_weekday", timeseries.counts_by_weekday),
                ("gap_stats", timeseries.gap_stats))]
        if numbers:
            steps += [(f"{name}_{ts}", lambda d, ts=ts, f=f: f(d, ts)) for name, f in (
                ("trend_lines", timeseries.trend_lines), ("rolling_trend", timeseries.rolling_trend), ("time_trend", timeseries.time_trend))]
    steps += [
        ("encoding_advice", features.encoding_advice), ("feature_advice", features.feature_advice), ("quality_issues", quality_issues),
        ("key_findings", key_findings)]
    return steps


def forest_outliers(df: DataFrame) -> DataFrame:
    """(row_hash, score): the rows that the isolation forest flags, named by a hash of all their columns."""
    cols = numeric_columns(df)
    rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in profiled(df)]).alias("row_hash"), *[F.col(f"`{c}`") for c in cols if c != "row_hash"])
    return isolation_forest(rows, ["row_hash"], [c for c in cols if c != "row_hash"]).where("is_outlier").select("row_hash", "score")


@dataclass
class Profile:
    run_id: str
    results: dict[str, DataFrame] = field(default_factory=dict)
    sources: dict[str, list[str]] = field(default_factory=dict)
    steps: DataFrame | None = None


def run_profile(
    df: DataFrame, out: str, steps: Sequence[Step] | None = None, extra: Sequence[Step] = (), attempts: int = K.STEP_ATTEMPTS,
    shown_rows: int = 20,
) -> Profile:
    """Run the steps in order and write each result below ``out``; an error ends its step only.

    A step that fails for a passing reason is tried again; one with an invalid plan or argument is not."""
    spark, profile, records = df.sparkSession, Profile(uuid.uuid4().hex), []
    todo = [*(steps if steps is not None else default_steps(df)), *extra]
    with shared_results(df):
        for number, (name, make) in enumerate(todo, 1):
            records.append((profile.run_id, number, name, *_run_step(df, name, make, f"{out}/{name}", attempts, shown_rows, profile)))
    profile.steps = small_frame(spark, records, RUN_STEPS)
    return profile


#: The analyses that every column of a class needs; those of a date column carry its name.
MANDATORY = {
    NUMERIC: ("numeric_describe", "histogram", "boxplot_stats", "normality_test", "outlier_ranking"),
    CATEGORICAL: ("value_counts", "cardinality_class", "encoding_advice"),
    DATETIME: ("date_range", "counts_by_year", "counts_by_month", "counts_by_weekday", "gap_stats"),
}


def coverage_gaps(df: DataFrame, profile: Profile) -> DataFrame:
    """(column, class, analysis): the mandatory analyses that no result of the run holds for a column.

    The step of a date column is named after it, as its result may come from an intermediate table that has no lineage."""
    classes = {c: k for k in MANDATORY for c in columns_of(df, k)}
    needed = [(c, k, name, f"{name}_{c}" if k == DATETIME else name) for c, k in classes.items() for name in MANDATORY[k]]
    wanted = small_frame(df.sparkSession, needed, "column string, class string, analysis string, step string")
    named = {n: r for n, r in profile.results.items() if n in {x[3] for x in needed}}
    dated = {step: [c] for c, k, _, step in needed if k == DATETIME and step in named}
    covered = overview.column_coverage(df, named, {**{n: c for n, c in profile.sources.items() if n in named}, **dated})
    held = covered.select("column", F.explode(F.split("analyses", ",")).alias("step"))
    return wanted.join(held, ["column", "step"], "left_anti").select("column", "class", "analysis")


def _shown(result: DataFrame, rows: int) -> str:
    """The first rows in the order of the columns, as text; rows left out are counted in a last line."""
    order = [F.col(f"`{f.name}`") for f in result.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    first = (result.orderBy(*order) if order else result).limit(rows + 1).toPandas()
    text = first.iloc[:rows].to_string()
    return f"{text}\n[{rows} of {result.count()} rows shown]" if len(first) > rows else text


def _run_step(df: DataFrame, name: str, make: Callable, path: str, attempts: int, shown_rows: int, profile: Profile) -> tuple:
    """(text_output, charts, error, attempts, seconds) of one step."""
    start, error, text, tried = time.time(), None, "", 0
    while tried < attempts:
        tried += 1
        try:
            made = make(df)
            profile.sources[name] = overview.lineage(df, made)
            made.write.mode("overwrite").parquet(path)
            profile.results[name] = df.sparkSession.read.parquet(path)
            text, error = _shown(profile.results[name], shown_rows), None
            break
        except (AnalysisException, ParseException, ValueError, TypeError, KeyError) as e:
            error = f"{type(e).__name__}: {e}"
            break
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    return text, 0, error, tried, round(time.time() - start, 3)


def write_report(profile: Profile, report: DataFrame, path: str) -> str:
    """Write the steps, the report rows and one Markdown text; returns the text.

    The result tables are already on disk.  The report has a few rows per column, so it fits the driver."""
    profile.steps.write.mode("overwrite").parquet(f"{path}/run_steps")
    report.write.mode("overwrite").parquet(f"{path}/insights")
    lines, last = [f"# Profile {profile.run_id}"], None
    for r in report.orderBy("position").collect():
        if r["section"] != last:
            lines += ["", f"## {r['section']}", ""]
            last = r["section"]
        lines.append(f"- {r['text']}")
    text = "\n".join(lines) + "\n"
    small_frame(report.sparkSession, [(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    return text
