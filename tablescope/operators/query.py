"""Ad-hoc queries on one table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.columns import col
from ..plans.sampling import lowest_by_hash

READ_ONLY = re.compile(r"^\s*(select|with|values|from)\b", re.IGNORECASE)
TEXT_ROWS = 100
# The nodes that an analysed query may have.  Views and relations stand only below the frame's own view, which is not searched.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except Window WithWindowDefinition "
    "SubqueryAlias WithCTE CTERelationDef CTERelationRef Generate Expand Sample Repartition RepartitionByExpression RebalancePartitions ResolvedHint "
    "OneRowRelation LocalRelation Range Subquery".split())
# Functions come from these packages; the named ones of them run code by its name, read the session's files or user code.
PACKAGES = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis.")
REFUSED = frozenset("CallMethodViaReflection TryReflect ScalaUDF ScalaUDAF PythonUDF PythonUDAF PythonUDTF InputFileName InputFileBlockStart InputFileBlockLength".split())


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _class(node) -> str:
    return node.getClass().getName()


def _refuse_calls(expression) -> None:
    name = _class(expression)
    if not name.startswith(PACKAGES) or name.rsplit(".", 1)[1] in REFUSED:
        raise ValueError(f"{expression.prettyName()} is not accepted in a query")
    for child in _all(expression.children()):
        _refuse_calls(child)


def _refuse_reads(plan, own: str) -> None:
    """Raise for anything in an analysed plan that is no plain query of the view ``own``."""
    name = _class(plan).rsplit(".", 1)[1].rstrip("$")
    if name == "View" and plan.desc().identifier().table() == own:
        return
    if name not in NODES:
        raise ValueError("only queries of the table itself are accepted")
    for expression in _all(plan.expressions()):
        _refuse_calls(expression)
    for inner in (*_all(plan.children()), *_all(plan.subqueries())):
        _refuse_reads(inner, own)


def query_table(df: DataFrame, sql: str) -> DataFrame:
    """Run one query that sees the table as ``df`` and nothing else.

    The name is a common table expression over a view that exists only while the statement is analysed, so no view of the session is
    replaced.  The statement stands in brackets, where only a query can stand; its analysed plan may read that view and inline
    values, and call the built-in functions that compute from their arguments."""
    if not READ_ONLY.match(sql):
        raise ValueError("only SELECT or WITH statements are accepted")
    spark, own = df.sparkSession, "_table_" + uuid.uuid4().hex
    df.createOrReplaceTempView(own)
    try:
        result = spark.sql(f"WITH df AS (SELECT * FROM {own}) (\n{sql.rstrip().rstrip(';')}\n)")
        _refuse_reads(result._jdf.queryExecution().analyzed(), own)
    except ParseException as e:
        raise ValueError(f"only one SELECT or WITH statement is accepted: {e}") from e
    finally:
        spark.catalog.dropTempView(own)
    return result


def query_text(df: DataFrame, sql: str, chars: int = K.QUERY_TEXT_CHARS, rows: int = TEXT_ROWS) -> str:
    """The result as text of at most ``chars`` characters of its first ``rows`` rows; rows left out are counted in a last line.

    An error comes back as text."""
    try:
        result = query_table(df, sql)
        shown = result.limit(rows + 1).toPandas()
        out = shown.iloc[:rows].to_string()
        if len(shown) > rows:
            out += f"\n[{rows} of {result.count()} rows shown]"
    except Exception as e:  # the caller reads the message like any other answer
        return f"ERROR: {e}"
    return out if len(out) <= chars else out[:chars] + K.CUT_OPEN + str(len(out)) + K.CUT_CLOSE


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate)


def lookup_value(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(col(key) == F.lit(value))


def aggregate_by(df: DataFrame, by: Sequence[str], aggregates: dict[str, str], predicate: str | None = None) -> DataFrame:
    """Filter, group, aggregate; ``aggregates`` maps result names to SQL expressions.  Rows with a missing key are left out."""
    rows = df.where(predicate) if predicate else df
    for k in by:
        rows = rows.where(col(k).isNotNull())
    return rows.groupBy(*[col(k) for k in by]).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def top_k(df: DataFrame, order_by: str, k: int, ties: Sequence[str], ascending: bool = False) -> DataFrame:
    """The first k rows by a column; ``ties`` make the choice unique.  No full sort: every task keeps k rows."""
    first = col(order_by).asc_nulls_last() if ascending else col(order_by).desc_nulls_last()
    return df.orderBy(first, *[col(t) for t in ties]).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).distinct()


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones however the data is partitioned."""
    return lowest_by_hash(df, key, n, seed)


def suggested_answers(df: DataFrame, order_by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Fixed result tables for the six questions a new user asks."""
    from ..plans.shared import shared_results
    from .anomalies import outlier_ranking
    from .features import feature_advice
    from .missing import missing_ranking
    from .relations import corr_pairs
    from .report import key_findings, quality_issues

    with shared_results(df):
        return {
            "key_findings": key_findings(df, top=3),
            "missing_data": missing_ranking(df),
            "correlations": corr_pairs(df).orderBy(F.desc(F.abs("r")), "col_a", "col_b"),
            "outliers": outlier_ranking(df),
            "next_steps": feature_advice(df),
            "quality_issues": quality_issues(df),
        }
