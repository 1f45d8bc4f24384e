"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies are masks over the stored bits.

All of it is DataFrame functions.  The measurements of a text need its words only, so the table is read once and nothing is shuffled;
only the ablation counts are grouped, by the bits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .texts import WORD, let, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition on the structure of measurements; null counts as passed."""

    bit: int
    name: str
    failed: Callable[[Column], Column]


RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(3, "long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule(4, "symbols", lambda m: 2 * m["n_symbols"] > m["n_words"]),
    Rule(5, "repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule(6, "very_few_words", lambda m: m["n_words"] < 5),
)
#: A policy is a version of the decision: the rules that reject a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines"),
    "lenient": ("very_few_words", "repeated_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in set(policy))


def _pairs(hashes: Column, shift: int) -> Column:
    """The hash of each value with the one ``shift`` places on."""
    n = F.size(hashes)
    there = F.greatest(n - shift, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), there), F.slice(hashes, F.lit(shift + 1), there), lambda a, b: F.xxhash64(a, b))


def _repeat_words(words: Column) -> Column:
    """The words that lie in a window of eight words found twice or more in the text.

    Window hashes come from three doublings of the word hashes.  Texts whose windows are all different, nearly all of them, stop there;
    in the others the windows are sorted with their places, neighbours of equal hash mark the repeated places, and the gaps between
    those places give the words covered.  The work is n log n in the words of a text."""
    none = F.lit(0).cast("long")

    def repeated_places(placed: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(placed, i)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        after = F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0)))
        new = F.zip_with(places, after, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(new, none, lambda total, x: total + x)

    def in_repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(placed, repeated_places), covered)).otherwise(none)

    hashes = F.transform(words, lambda word: F.xxhash64(word))
    return let(let(let(let(hashes, lambda w: _pairs(w, 1)), lambda w: _pairs(w, 2)), lambda w: _pairs(w, 4)), in_repeated)


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
    )


def _measures(text: Column) -> Column:
    """All measurements of a text in one structure."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    symbols = F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long")
    return let(
        F.struct(let(word_array(text), _of_words).alias("w"), let(lines, _of_lines).alias("l"), symbols.alias("s")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["s"].alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def _failure_bits(measures: Column, rules: Sequence[Rule]) -> Column:
    """The bits of the failed rules, from the measurements alone."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.failed(measures), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def rule_ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, every measurement and ``failed_bits``, the bits of the rules that the text fails.

    A null or empty text has no words, symbols or repeated lines.  Lines count if they hold a word; a line is repeated if it equals an
    earlier one in every character.  Repeated rows give repeated rows, an empty table an empty ledger, further columns are ignored."""
    rows = docs.select(F.col(key).alias(key), _measures(F.col(text)).alias("m"))
    return rows.select(key, *[F.col("m")[c].alias(c) for c in MEASURES], _failure_bits(F.col("m"), rules).alias("failed_bits"))


def apply_policy(ledger: DataFrame, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed.  Texts are not read again."""
    return ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(ledger: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: texts that fail the rule, that only this rule rejects, and that would be kept without it.

    The ledger is grouped by its bits first, with partial sums on each task, so what follows depends on the number of rules only."""
    by_bits = ledger.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    names = {r.name: r for r in rules}
    asked = F.array(*[
        F.struct(
            F.lit(version).alias("policy"), F.lit(name).alias("rule"),
            F.lit(mask(policy, rules)).cast("long").alias("policy_mask"), F.lit(1 << names[name].bit).cast("long").alias("rule_mask"),
        )
        for version, policy in policies.items() for name in policy
    ])
    failed = F.col("failed_bits").bitwiseAND(F.col("policy_mask"))
    pairs = by_bits.select("*", F.inline(asked))
    return pairs.groupBy("policy", "rule").agg(
        F.sum(F.when(failed.bitwiseAND(F.col("rule_mask")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("rule_mask"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not(F.col("rule_mask"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filter_quality(docs: DataFrame, policy: Sequence[str] = POLICIES["v1"], rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they are; a null or empty text fails ``few_words``."""
    return docs.where(let(_measures(F.col(text)), lambda m: _failure_bits(m, rules).bitwiseAND(F.lit(mask(policy, rules)).cast("long"))) == 0)
