"""Importance resampling towards a target text collection, over hashed n-gram buckets.

A buffer of texts is interned in one open-addressed table of numpy arrays: the xxhash64 of an n-gram is its key, a slot names the first
occurrence and belongs to an n-gram only if the bytes agree, and each slot holds the n-gram's bucket and count.  Bucket counts come from the
slots, weights from the slot numbers of the occurrences.  The working memory is some twelve bytes for each byte of a buffer, which is about
BATCH bytes or one longer text."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import cut_along, scan
from .scratch import stored
from .texts import BATCH, column_bytes

N_BUCKETS = 10_000
LAST_ID = (1 << 63) - 1

#: Fixed values of the xxhash64 algorithm.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SHORT = 32

_CLEAN = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _CLEAN[_low:_high] = np.arange(_low, _high)
_CLEAN[65:91] = np.arange(97, 123)
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


class Buffer:
    """Bytes with a view of the eight and of the four bytes from any place on."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.concatenate([data, np.zeros(8, np.uint8)])
        self.size = len(data)
        self.eight = np.ndarray((self.size + 1,), "<u8", self.bytes, strides=(1,))
        self.four = np.ndarray((self.size + 5,), "<u4", self.bytes, strides=(1,))


def _short_hashes(data: Buffer, starts: np.ndarray, n: int) -> np.ndarray:
    """xxhash64, seed 0, of the n < 32 bytes at each start."""
    h = np.full(len(starts), _P5 + np.uint64(n))
    at = 0
    while at + 8 <= n:
        h = _turn(h ^ (_turn(data.eight[starts + at] * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if at + 4 <= n:
        h = _turn(h ^ (data.four[starts + at].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += 4
    for i in range(at, n):
        h = _turn(h ^ (data.bytes[starts + i].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def range_hashes(data: Buffer, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxhash64 of byte ranges: those below 32 bytes together by their length, longer ones one by one."""
    out = np.zeros(len(starts), np.uint64)
    kind = np.minimum(lengths, _SHORT).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=_SHORT + 1))
    for n in range(1, _SHORT):
        which = order[ends[n - 1]:ends[n]]
        if len(which):
            out[which] = _short_hashes(data, starts[which], n)
    raw = memoryview(data.bytes)
    for i in order[ends[_SHORT - 1]:].tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + lengths[i]])
    return out


def _equal(data: Buffer, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ranges at a and b have the same bytes."""
    same = np.ones(len(a), bool)
    left, at = np.arange(len(a)), 0
    while len(left):
        rest = lengths[left] - at
        differ = (data.eight[a[left] + at] ^ data.eight[b[left] + at]) & _TAIL[np.minimum(rest, 8)]
        same[left[differ != 0]] = False
        left, at = left[(differ == 0) & (rest > 8)], at + 8
    return same


class GramTable:
    """The n-grams of one buffer.  ``slot`` has a slot number for each occurrence; ``bucket`` and ``count`` are by slot."""

    def __init__(self, data: Buffer, starts: np.ndarray, lengths: np.ndarray, n_buckets: int, hashes: np.ndarray | None = None):
        hashes = range_hashes(data, starts, lengths) if hashes is None else hashes
        size = 1 << max(4, int(2 * len(starts)).bit_length())
        owner = np.full(size, -1, np.int64)
        self.slot = (hashes & np.uint64(size - 1)).astype(np.int64)
        waiting = np.arange(len(starts))
        while len(waiting):
            at = self.slot[waiting]
            free = owner[at] < 0
            owner[at[free]] = waiting[free]
            first = owner[at]
            same = (hashes[first] == hashes[waiting]) & (lengths[first] == lengths[waiting])
            same[same] = _equal(data, starts[first[same]], starts[waiting[same]], lengths[waiting[same]])
            waiting = waiting[~same]
            self.slot[waiting] = (self.slot[waiting] + 1) & (size - 1)
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        raw, begin = memoryview(data.bytes), starts[owner[self.used]]
        end = begin + lengths[owner[self.used]]
        self.bucket[self.used] = [zlib.crc32(raw[a:b]) % n_buckets for a, b in zip(begin.tolist(), end.tolist())]


class Grams:
    """All runs of 1 to n words of some texts: their byte ranges in one cleaned buffer, the text of each, and the words of each text."""

    def __init__(self, texts: list[bytes], n: int):
        raw = _CLEAN[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        word = raw != 32
        first = word.copy()
        first[1:] &= ~word[:-1]
        keep = word.copy()
        keep[1:] |= word[:-1]
        begins = np.flatnonzero(first)
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, begins, "right")
        self.n_words = np.bincount(text, minlength=len(texts))
        self.data = Buffer(raw[keep])
        gaps = np.flatnonzero(self.data.bytes[:self.data.size] == 32)
        starts = np.concatenate([np.zeros(1, np.int64), gaps + 1])[:len(begins)]
        stops = gaps[:len(begins)]
        ranges = [(np.flatnonzero(text[m:] == text[:len(text) - m]) if m else np.arange(len(text)), m) for m in range(min(n, len(text)))]
        self.starts = np.concatenate([starts[i] for i, _ in ranges] or [starts])
        self.lengths = np.concatenate([stops[i + m] - starts[i] for i, m in ranges] or [stops])
        self.text = np.concatenate([text[i] for i, _ in ranges] or [text])


def _buffers(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch in buffers of about BATCH bytes."""
    held, size = [], 0
    for text in column_bytes(column):
        held.append(text)
        size += len(text)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_counts(texts: DataFrame, n: int = 1, n_buckets: int = N_BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n) of all n-grams of all texts; a task sends one row for each bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for some in _buffers(batch.column(0)):
                grams = Grams(some, n)
                table = GramTable(grams.data, grams.starts, grams.lengths, n_buckets)
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """The gain of every bucket from the two tables of bucket counts; ``n_buckets`` numbers of each reach the driver."""
    s, t = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
    for counts, into in ((source, s), (target, t)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum() + n_buckets), float(t.sum() + n_buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, n: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for some in _buffers(batch.column(1)):
                grams = Grams(some, n)
                table = GramTable(grams.data, grams.starts, grams.lengths, len(gains))
                gain = gains[table.bucket][table.slot]  # whole numbers below 2^53 in sum, so doubles add them exactly
                found.append((grams.n_words, np.bincount(grams.text, minlength=len(some)), np.bincount(grams.text, gain, len(some)).astype(np.int64)))
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_words long, n_features long, weight long")


def _noise(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of a key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_sample(
    docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, n_buckets: int = N_BUCKETS, min_words: int = 20, seed: int = 2024,
    text: str = "text", key: str = "doc_id", target_text: str = "text",
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``.

    Words are runs of 0-9, a-z after A-Z are lower-cased, and characters beyond ASCII; features are all runs of 1 to ``n`` words of a
    text.  ``rank`` counts from 1 over the ``percent`` of the rows with ``min_words`` words that have the highest scores and is null for all others;
    ties go to the smaller key, a null key comes last and draws its noise as an empty one, and rows that agree in key and score follow
    in order of their features and weight.  Null and empty texts have no features and weight 0; an empty target has only empty
    buckets; empty ``docs`` give no rows.  Repeated rows each count.  Other columns are ignored whatever their names."""
    counts = [bucket_counts(t, n, n_buckets, c) for t, c in ((docs, text), (target, target_text))]
    rows = weighed(docs, bucket_gains(*counts, n_buckets), n, text, key)
    rows = rows.withColumn("score", F.col("weight") + _noise(F.col("key"), seed))
    rows = stored(rows.withColumns({"low": -F.col("score"), "tie": F.coalesce("key", F.lit(LAST_ID)), "one": F.lit(1)}), "weighed")
    fit = rows.where(F.col("n_words") >= min_words)
    draw = fit.agg(F.count(F.lit(1)).alias("n")).first()["n"] * percent // 100
    cut, buckets = cut_along(fit, "low", "tie")
    ranked = scan(cut, buckets, ["low", "tie", "n_features", "weight"], {"place": "one"})
    place = F.when(F.col("place") <= draw, F.col("place")).cast("long")
    columns = [F.col("key").alias(key), "n_words", "n_features", "weight", "score"]
    unfit = rows.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, place.alias("rank")).unionByName(unfit)
