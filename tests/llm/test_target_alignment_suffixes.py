"""Target resampling, tokenizer alignment and suffix-array dedup against plain versions."""

import collections
import hashlib
import math
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from tablescope.llm import alignment, importance, suffix_dedup, suffixes
from tablescope.llm.queries import QUERIES

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
CLASH = "key long, row string, h long, doc long, rank int, body string, score double, g int, pairs string, low string, n_words int, `a.b` int"
DOCS = f"doc_id long, text string, {CLASH}"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE two-three"), (6, "é" * 150), (7, "y" + "é" * 149), (None, "x" * 300), (None, "x" * 300),
    (8, "ab" * 300), (9, LONG), (10, "start " + LONG + " end"), (10, "start " + LONG + " end"), (11, "<|endoftext|> x"), (12, "▁ a"), (13, "漢字 かな 👩‍👩‍👧 \x00\r\n\tz"),
    (14, " ".join(f"w{i}" for i in range(30))), (14, " ".join(f"v{i}" for i in range(30))), (None, " ".join(f"u{i}" for i in range(25))), (15, "q" * 199), (15, "q" * 199),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x" if "string" in c else 1.0 if "double" in c else 7 for c in CLASH.split(", ")]) for r in rows], DOCS)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text, n):
    words = WORD.findall(bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode()))
    return [b" ".join(words[i:i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)], len(words)


def plain_sample(rows, target, n, percent=10, n_buckets=10_000):
    grams = [plain_grams(t, n) for _, t in rows]
    s = collections.Counter(zlib.crc32(g) % n_buckets for x, _ in grams for g in x)
    t = collections.Counter(zlib.crc32(g) % n_buckets for x in target for g in plain_grams(x, n)[0])
    all_s, all_t = sum(s.values()) + n_buckets, sum(t.values()) + n_buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(n_buckets)]
    out = []
    for (key, _), (x, words) in zip(rows, grams):
        weight = sum(gain[zlib.crc32(g) % n_buckets] for g in x)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = collections.defaultdict(list)
    for place, r in enumerate(fit):
        drawn[r].append(place + 1 if place < len(fit) * percent // 100 else None)
    return [(*r, drawn[r].pop(0) if r in drawn else None) for r in out]


@pytest.mark.parametrize("n, percent", [(1, 10), (3, 50)])
def test_sample_of_odd_rows(spark, n, percent):
    target = ["one two three", None, "", "w1 w2 w3 w4 v1"]
    docs, wanted = frame(spark), spark.createDataFrame([(x,) for x in target], "text string")
    found = importance.importance_sample(docs, wanted, percent=percent, n=n)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert ordered(found.collect()) == ordered(plain_sample(ROWS, target, n, percent))
    assert importance.importance_sample(docs.where("doc_id < 0"), wanted).count() == 0
    assert ordered(importance.importance_sample(docs, wanted.where("text = 'no'")).collect()) == ordered(plain_sample(ROWS, [], 1))


def test_sample_of_one_score(spark):
    rows = [(None, " ".join(f"w{i}" for i in range(20)))] * 300 + [(i, " ".join(f"w{i}" for i in range(20))) for i in range(300)]
    wanted = spark.createDataFrame([("w1 w2",)], "text string")
    found = importance.importance_sample(frame(spark, rows), wanted, percent=80)
    assert ordered(found.collect()) == ordered(plain_sample(rows, ["w1 w2"], 1, 80))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB9é -\x00", max_size=90), max_size=6), st.integers(1, 3))
def test_gram_table(texts, n):
    grams = importance.Grams([t.encode() for t in texts], n)
    wanted = [(i, g) for i, t in enumerate(texts) for g in plain_grams(t, n)[0]]
    found = [(int(i), bytes(grams.data.bytes[a:a + m])) for i, a, m in zip(grams.text, grams.starts, grams.lengths)]
    assert sorted(found) == sorted(wanted)
    hashes = importance.range_hashes(grams.data, grams.starts, grams.lengths)
    assert hashes.tolist() == [xxhash.xxh64_intdigest(g) for _, g in found]
    counts = collections.Counter(g for _, g in found)
    for clash in (hashes, np.zeros(len(hashes), np.uint64)):  # with equal hashes the bytes decide
        table = importance.GramTable(grams.data, grams.starts, grams.lengths, 1000, clash)
        assert len(table.used) == len(counts)
        assert all(table.count[s] == counts[g] and table.bucket[s] == zlib.crc32(g) % 1000 for s, (_, g) in zip(table.slot, found))


def plain_alignment(rows):
    a, b = alignment.byte_level(A), alignment.pieces(B)
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    out = []
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        x, y = (tokenizer.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if any(b"".join(v.bytes[i] for i in ids) != whole for v, ids in ((a, x), (b, y))):
            x, y = [], []
        i = j = end_a = end_b = 0
        groups, links = [], collections.Counter()
        while i < len(x):
            group_a, group_b = [], []
            while not group_a or end_a != end_b:
                if end_a <= end_b:
                    group_a.append(x[i])
                    end_a, i = end_a + len(a.bytes[x[i]]), i + 1
                else:
                    group_b.append(y[j])
                    end_b, j = end_b + len(b.bytes[y[j]]), j + 1
            groups.append(",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b)))
            links.update((p, q) for p in group_a for q in group_b)
        out.append((key, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    held = collections.Counter(pair for r in out for pair in r[4])
    most = collections.defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return [(*r[:4], sum(r[4].values()), sum(n for (p, q), n in r[4].items() if held[p, q] == most[p]),
             sum(n * held[pair] for pair, n in r[4].items()), r[5]) for r in out]


def test_alignment_of_odd_rows(spark):
    wanted = ordered(plain_alignment(ROWS))
    for piece, frequent in ((512, 1 << 18), (3, 0), (64, 200)):
        assert ordered(alignment.align_tokenizers(frame(spark), A, B, piece, frequent).collect()) == wanted
    assert alignment.align_tokenizers(frame(spark, []), A, B).count() == 0


def test_alignment_query(spark, read):
    rows = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    found = QUERIES["op13_tokenizer_links"][0](spark, SF)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(found.collect()) == ordered(plain_alignment(rows))


def test_wide_groups_are_counted_by_id(monkeypatch):
    texts = [t for _, t in ROWS if t and len(t) < 1000]
    align = alignment.Aligner(alignment.byte_level(A), alignment.pieces(B), 5)
    one = [(r[:5], r[5].tolist(), r[6].tolist()) for r in align(texts)]
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert [(r[:5], r[5].tolist(), r[6].tolist()) for r in align(texts)] == one


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(1, 9))
def test_merge_paths(a, b, piece):
    x, y = (np.array(sorted(s), np.int64) for s in (a, b))
    i, j = alignment.shared_ends(x, y, piece)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)


def plain_removal(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[p:p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((key, len(t), sum(gone), len(spans), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def removed(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    return ordered((*r[:4], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows)


def test_removal_of_odd_rows(spark):
    rows = [(k, t[:3000] if t else t) for k, t in ROWS]
    wanted = ordered(plain_removal(rows, 200))
    for options in ({}, {"crowd": 1}, {"anchor": 200}, {"anchor": 9, "crowd": 2}):
        assert removed(frame(spark, rows), **options) == wanted
    assert removed(frame(spark, [])) == []


def test_removal_with_crowded_anchors(spark, monkeypatch):
    """A passage in many texts, each with words of its own around it: its anchors are dealt to several shards."""
    rng = np.random.default_rng(2)
    passage, parts = bytes(rng.integers(97, 123, 90)).decode(), [bytes(rng.integers(97, 123, 30)).decode() for _ in range(12)]
    rows = [(i, parts[rng.integers(12)] + parts[rng.integers(12)] + passage + parts[rng.integers(12)] + str(i) + passage[:45]) for i in range(300)]
    wanted = ordered(plain_removal(rows, 60))
    assert any(0 < r[2] < r[1] for r in wanted)
    for crowd in (4, 50, 10_000):
        assert removed(frame(spark, rows), width=60, anchor=20, crowd=crowd) == wanted
    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 200)
    assert removed(frame(spark, rows), width=60, anchor=20, crowd=4) == wanted


def test_removal_query(spark, read):
    rows = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    found = QUERIES["op12_suffix_arrays"][0](spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert ordered(found.collect()) == ordered((*r[:4], hashlib.sha256(r[5]).hexdigest()) for r in plain_removal(rows, 200))


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_suffix_arrays(data, repeat, lanes):
    data = np.frombuffer(data * repeat, np.uint8)
    order, rank = suffixes.suffix_array(data)
    tails = [bytes(data[i:]) + b"\xff" * (len(data) + 9) for i in order]
    assert [t[:len(data)] for t in tails] == sorted(t[:len(data)] for t in tails) and rank[order].tolist() == list(range(len(data)))
    shared = suffixes.common_prefixes(data, order, rank, 7, lanes)
    for left, right, n in zip(tails, tails[1:], shared[1:]):
        assert n == next((i for i in range(7) if left[i] != right[i]), 7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8), st.integers(1, 12))
def test_equal_windows_share_their_anchor(texts, k):
    width, texts = 12, [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    text, start, n, anchor, _ = suffixes.anchored_runs(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, width, k)
    windows = [(t, s + i, a) for t, s, m, a in zip(text.tolist(), start.tolist(), n.tolist(), anchor.tolist()) for i in range(m)]
    assert sorted(w[:2] for w in windows) == [(t, p) for t in range(len(texts)) for p in range(len(texts[t]) - width + 1)]
    known = {}
    assert all(known.setdefault(texts[t][p:p + width], a) == a for t, p, a in windows)


def test_merged_runs_add_up():
    runs = [(np.array([b"a", b"c"], "S1"), np.array([1, 1])), (np.array([b"c", b"d"], "S1"), np.array([2, 1])), (np.array([b"0"], "S1"), np.array([1]))]
    keys, totals = suffix_dedup.merge_runs(runs)
    assert keys.tolist() == [b"0", b"a", b"c", b"d"] and totals.tolist() == [1, 1, 3, 1]
