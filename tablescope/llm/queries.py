"""The operators of this package as queries over the test tables, with the SQL they must agree with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import alignment, importance, licences, line_dedup, mixing, ngram_join, packing, quality, secret_scan, suffix_dedup, token_files, vector_dedup, warc
from .scratch import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ngram_groups(spark: SparkSession, sf: str) -> DataFrame:
    """op1: documents linked by a similarity of 0.9 or more of their three-word shingles."""
    return ngram_join.ngram_components(table(spark, sf, "documents"), 3, (9, 10))


def pq_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """op2: vectors of one label with a cosine of 0.93 or more."""
    return vector_dedup.keep_one_of_each(table(spark, sf, "embeddings"))


def line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """op3: documents without the lines that three or more of them share."""
    rows = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """op4: how many words a mix with source weights 1, 2, 3 takes from each document."""
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("repeat"),
    )


def licence_templates(spark: SparkSession, sf: str) -> DataFrame:
    """op5: licence notices in documents; one row for each document and licence."""
    found = licences.find_licences(table(spark, sf, "documents"))
    dice = F.round(2 * F.col("common") / (F.col("n_run") + F.col("n_template")), 6)
    return found.select("doc_id", "licence", "common", "n_run", "n_template", dice.alias("dice"))


def warc_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """op6: pages in two WARC replicas, the second damaged by a rule on page_id; every record's size and whether the replicas agree."""
    path = scratch_path(spark, "llm-warc")
    flipped = F.concat(F.lit("?"), F.expr("substring(body, 2)"))
    shorter, longer = F.expr("left(body, length(body) - 1)"), F.concat("body", F.lit("?"))
    blanked = F.repeat(F.lit("0"), F.octet_length("body"))
    hurt = F.when(F.col("key") % 3 == 0, flipped).when(F.col("key") % 3 == 1, shorter).otherwise(longer)
    damaged = F.when(F.col("body") == "", F.col("body")).when(F.col("key") % 97 == 5, hurt).when(F.col("key") % 89 == 7, blanked)
    warc.write_replicas(table(spark, sf, "pages"), path, {"one": F.col("body"), "two": damaged.otherwise(F.col("body"))})
    one, two = (stored(warc.record_table(spark, f"{path}/replica={n}"), "warc-records") for n in ("one", "two"))
    wrong = stored(warc.audit(one, two), "warc-wrong")
    extra = wrong.where("state = 'extra'").select("volume", F.col("start_two").alias("start"), "state")
    joined = one.join(wrong.drop("start_two"), ["volume", "start"], "left").unionByName(two.join(extra, ["volume", "start"]))
    return joined.select(
        F.expr("try_cast(regexp_extract(record_id, '([0-9-]+)$', 1) AS long)").alias("page_id"), F.col("length").alias("n_bytes"),
        F.coalesce("state", F.lit("intact")).alias("state"), "digest",
    )


def _of_kinds(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def id_files(spark: SparkSession, sf: str) -> DataFrame:
    """op7: token ids of every document, as the tokenizer's plain ``encode`` gives them, in compressed, checked blocks, read back."""
    import public_tokenizers

    path = scratch_path(spark, "llm-ids")
    token_files.write_ids(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return token_files.read_index(spark, path)


def blob_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """op8: secrets of every document, each content scanned once."""
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "llm-ledger"))
    found = secret_scan.find_secrets(table(spark, sf, "documents"), ledger)
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    return found.select(
        "doc_id", *[F.size(_of_kinds([k])).cast("long").alias("n_" + k) for k in kinds],
        F.sha2(secret_scan.span_list(_of_kinds(kinds)), 256).alias("base_sha256"), secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """op9: documents in batches of 16,384 words, padded to one of sixteen lengths."""
    return packing.pack(table(spark, sf, "documents"))


def rule_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """op10: measurements, failure bits and the verdict of policy v1."""
    ledger = quality.rule_ledger(table(spark, sf, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.mask(quality.POLICIES["base"])).cast("long")) != 0
    return quality.apply_policy(ledger, quality.POLICIES["v1"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed_bits", base.alias("base_failed"),
        "kept",
    )


def target_sample(spark: SparkSession, sf: str) -> DataFrame:
    """op11: the tenth of the documents with twenty words or more that is drawn towards the benchmark's texts."""
    rows = importance.importance_sample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """op12: documents without the passages of 200 bytes that occur more than once."""
    rows = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_links(spark: SparkSession, sf: str) -> DataFrame:
    """op13: groups and links between the tokens of two public tokenizers, in every document."""
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokenizers(table(spark, sf, "documents"), a, b)


_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NGRAM_GROUPS_SQL = rf"""
WITH RECURSIVE lowered AS (SELECT doc_id, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS text FROM documents),
words AS (SELECT doc_id, {_WORDS} AS w FROM lowered),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))
    WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT sets.doc_id, len(s) AS n_shingles, least(sets.doc_id, coalesce(min(b), sets.doc_id)) AS component_id
FROM sets LEFT JOIN reach ON reach.a = sets.doc_id GROUP BY sets.doc_id, s"""

PQ_NEIGHBOURS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(n, " ".join(t.split()).replace("'", "''")) for n, t in licences.TEMPLATES.items())
_PLAIN = f"regexp_replace(translate({{}}, {_UPPER}, {_LOWER}), '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', ' ', 'g')"
_TWO = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
LICENCE_TEMPLATES_SQL = f"""
WITH t AS (SELECT licence, {_TWO.format("w")} AS g FROM (SELECT licence, list_filter(string_split({_PLAIN.format("body")}, ' '), lambda x: x <> '') AS w
    FROM (VALUES {_TEMPLATE_ROWS}) v(licence, body))),
d AS (SELECT doc_id, string_split({_PLAIN.format("coalesce(text, '')")}, chr(10)) AS lines FROM documents),
whole AS (SELECT doc_id, lines, {_TWO.format("w")} AS g FROM (SELECT doc_id, lines, list_filter(string_split(array_to_string(lines, ' '), ' '), lambda x: x <> '') AS w FROM d)),
able AS (SELECT doc_id, lines, licence, t.g FROM whole JOIN t ON len(list_intersect(whole.g, t.g)) * 6 >= 4 * len(t.g)),
starts AS (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM able), runs AS (SELECT *, unnest(range(i, len(lines) + 1)) AS j FROM starts),
words AS (SELECT *, list_filter(string_split(array_to_string(list_slice(lines, i, j), ' '), ' '), lambda x: x <> '') AS w FROM runs),
two AS (SELECT doc_id, licence, i, j, g, {_TWO.format("w")} AS r FROM words),
scored AS (SELECT doc_id, licence, i, j, len(list_intersect(r, g)) AS common, len(r) AS n_run, len(g) AS n_template FROM two),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY 2.0 * common / (n_run + n_template) DESC, n_run) AS k
    FROM scored WHERE 10 * common >= 4 * (n_run + n_template))
SELECT doc_id, licence, common, n_run, n_template, round(2 * common / (n_run + n_template), 6) AS dice FROM best WHERE k = 1"""

_RECORD = (
    "'WARC/1.0' || E'\\r\\n' || 'WARC-Type: resource' || E'\\r\\n' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || E'\\r\\n' || "
    "'WARC-Date: 1970-01-01T00:00:00Z' || E'\\r\\n' || coalesce('WARC-Target-URI: ' || url || E'\\r\\n', '') || "
    "'Content-Type: text/html; charset=utf-8' || E'\\r\\n' || 'Content-Length: ' || strlen(coalesce(html, '')) || E'\\r\\n\\r\\n' || "
    "coalesce(html, '') || E'\\r\\n\\r\\n'"
)
WARC_FIXITY_SQL = f"""
SELECT page_id, strlen(record) AS n_bytes, sha256(record) AS digest,
       CASE WHEN coalesce(html, '') <> '' AND (page_id % 97 = 5 OR page_id % 89 = 7) THEN 'changed' ELSE 'intact' END AS state
FROM (SELECT *, {_RECORD} AS record FROM pages)"""

LINE_RUNS_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_UPPER}, {_LOWER}) AS k FROM numbered),
shared AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND doc_id < top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (top IS NULL OR doc_id >= top), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id"""


def _spans_sql(kind: str, pattern: str, group: int, least: int, place: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place,
        list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: length(x))), 0) AS start,
        length(found[i]) AS n
    FROM (SELECT doc_id, gaps, found, worth, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', 0) AS found,
               regexp_extract_all(text, '{quoted}', {group}) AS worth FROM documents)) WHERE length(worth[i]) >= {least}"""


_ALL_SPANS = " UNION ALL ".join(_spans_sql(r.kind, r.pattern, r.group, r.least, i) for i, r in enumerate(secret_scan.RULES))
BLOB_SECRETS_SQL = f"""
WITH spans AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS span FROM ({_ALL_SPANS})),
each AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(span, ',' ORDER BY start, place) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN each USING (doc_id)"""

RULE_LEDGER_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM words WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 7)) AS n FROM starts),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM words LEFT JOIN covered USING (doc_id)),
filled AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars) FROM m),
bits AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) | (CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END)
    | (CASE WHEN 2 * n_symbols > n_words THEN 16 ELSE 0 END) | (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
    | (CASE WHEN n_words < 5 THEN 64 ELSE 0 END) AS b FROM filled)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, b::BIGINT AS failed_bits,
       (b & 3) <> 0 AS base_failed, (b & 63) = 0 AS kept FROM bits"""

_HEX = "(strpos('0123456789abcdef', substr({0}, {1}, 1)) - 1)"
_GRAMS = (
    "SELECT {0} unnest(regexp_extract_all(translate(coalesce(text, ''), {1}, {2}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {3}")
TARGET_SAMPLE_SQL = f"""
WITH RECURSIVE step AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
d AS ({_GRAMS.format("doc_id,", _UPPER, _LOWER, "documents")}), b AS ({_GRAMS.format("", _UPPER, _LOWER, "benchmark")}),
names AS (SELECT w, lower(hex(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
buckets AS (SELECT w, xor(list_reduce(list_transform(range(0, len(h) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 4294967295
    ELSE {_HEX.format("h", "2 * i - 1")} * 16 + {_HEX.format("h", "2 * i")} END), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS k
    FROM names, crc),
s AS (SELECT k, count(*) AS n FROM d JOIN buckets USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM b JOIN buckets USING (w) GROUP BY k),
sizes AS (SELECT (SELECT count(*) FROM d) + 10000.0::DOUBLE AS n_s, (SELECT count(*) FROM b) + 10000.0::DOUBLE AS n_t),
gains AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * n_s / ((s.n + 1) * n_t)))::BIGINT AS gain FROM sizes, s LEFT JOIN t ON s.k = t.k),
sums AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN buckets USING (w) JOIN gains USING (k) GROUP BY doc_id),
named AS (SELECT doc_id, sha256('2024:' || doc_id) AS h FROM documents),
noise AS (SELECT doc_id, floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: {_HEX.format("h", "i")}), lambda a, x: a * 16 + x)
    + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS g FROM named),
scored AS (SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + g AS score
    FROM documents JOIN noise USING (doc_id) LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""

QUERIES = {
    "op1_ngram_groups": (ngram_groups, NGRAM_GROUPS_SQL),
    "op2_pq_neighbours": (pq_neighbours, PQ_NEIGHBOURS_SQL),
    "op3_line_runs": (line_runs, LINE_RUNS_SQL),
    "op4_source_mix": (source_mix, None),
    "op5_licence_templates": (licence_templates, LICENCE_TEMPLATES_SQL),
    "op6_warc_fixity": (warc_fixity, WARC_FIXITY_SQL),
    "op7_id_files": (id_files, None),
    "op8_blob_secrets": (blob_secrets, BLOB_SECRETS_SQL),
    "op9_length_buckets": (length_buckets, None),
    "op10_rule_ledger": (rule_ledger, RULE_LEDGER_SQL),
    "op11_target_sample": (target_sample, TARGET_SAMPLE_SQL),
    "op12_suffix_arrays": (suffix_arrays, None),
    "op13_tokenizer_links": (tokenizer_links, None),
}
