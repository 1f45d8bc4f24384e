"""Secrets in every version of every text, scanned once for each content and rule version.

Texts are addressed by their SHA-256.  The ledger is a table with a row for each blob and scan: the rule versions that ran and the spans
they found.  A scan reads only blobs for which some rule version has not run, and only those rules run on them; findings are joined back
to all paths that ever held the blob.  All of it is DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import stored
from .texts import let


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule(
        "assign", 1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 8,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("host_token", 1, "gh[opsu]_[A-Za-z0-9]{36,}"),
)
SPANS = "array<struct<start:bigint,place:int,stop:bigint,kind:string>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"
BLOCK = 64


def _totals_before(lengths: Column) -> Column:
    """For each value the sum of those before it, by blocks: a long list takes far fewer steps than its length squared."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    return let(
        let(blocks, lambda sums: F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b)))),
        lambda before: F.transform(lengths, lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int")) + _sum(
            F.slice(lengths, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK))),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """The spans of a rule in code points: the pieces between matches and the matches give their starts."""
    pattern = F.lit(rule.pattern)
    parts = F.zip_with(
        F.zip_with(
            F.split(text, rule.pattern), F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda gap, match: F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("match")),
        ),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
        lambda p, value: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.length(value).alias("value")),
    )

    def placed(parts: Column) -> Column:
        before = _totals_before(F.transform(parts, lambda p: p["gap"] + F.coalesce(p["match"], F.lit(0).cast("long"))))
        return F.zip_with(parts, before, lambda p, b: F.struct(
            (b + p["gap"]).alias("start"), F.lit(place).alias("place"), (b + p["gap"] + p["match"]).alias("stop"),
            F.lit(rule.kind).alias("kind"), p["value"].alias("value"),
        ))

    good = F.filter(let(parts, placed), lambda s: s["value"] >= rule.least)
    spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def content_address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """The ledger below ``path``, a folder that all machines share.  Each scan adds one table in a single commit, so a scan that breaks
    off leaves nothing behind and is simply run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, texts: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
        """Run every rule version on every text for which it has not run.  Null is an empty text; repeated texts are one blob."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        blobs = texts.select(content_address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
        known = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        todo = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0)
        found = F.concat(*[
            F.when(F.array_contains("todo", r.key), _spans(F.col("text"), r, i)).otherwise(F.array().cast(SPANS))
            for i, r in enumerate(rules)
        ])
        todo.select("blob", F.col("todo").alias("rules"), found.alias("spans")).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """(blob, spans) over all scans, spans in order of start and then of rule."""
        spans = self.entries().where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        return stored(spans.select("blob", F.sort_array("spans").alias("spans")), "findings")


def find_secrets(docs: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, blob, spans) for every row of ``docs``, after a scan of what the ledger lacks.

    Null and empty texts have no spans.  Rows of equal text share a blob and its spans; repeated rows stay.  An empty table gives an
    empty result; a null key stays null; other columns are ignored.  Spans count code points, the end is exclusive."""
    ledger.scan(docs, rules, text)
    paths = docs.select(F.col(key).alias(key), content_address(F.col(text)).alias("blob"))
    joined = paths.join(ledger.findings(), "blob", "left")
    return joined.select(key, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
