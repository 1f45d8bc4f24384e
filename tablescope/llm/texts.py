"""Word and shingle hashes of whole texts, computed for many texts at once inside a task.

A word is a maximal run of bytes that are not ASCII white space, A-Z lower-cased.  Words and shingles are 64-bit hashes; the working
memory is a few times ``CHUNK`` plus eight bytes for each word of the texts in hand."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 20
BATCH = 1 << 21

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the fast built-in function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _codes() -> np.ndarray:
    """A fixed 64-bit number for each byte; letters share theirs across case and white space has zero."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]
    table[_SPACES] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = _codes()
_BASE = np.uint64(0x2545F4914F6CDD1D)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK), _BASE)]))
    return _powers


def _chunks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of about CHUNK bytes, cut at white space only."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield at, data[at:end]
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    hashes, begins = [], []
    for at, piece in _chunks(data):
        raw = np.frombuffer(piece, np.uint8)
        gap = _SPACES[raw]
        first = ~gap
        first[1:] &= gap[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            continue
        length = np.diff(np.append(start, len(raw)))
        place = np.arange(start[0], len(raw)) - np.repeat(start, length)
        value = _CODES[raw[start[0]:]] * _powers_to(int(length.max()) + 1)[place]
        hashes.append(mix(np.add.reduceat(value, start - start[0])))
        begins.append(start + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = mix(total + words[k:k + count] * np.uint64(2 * k + 3))
    return total


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles in order of their hash; of fewer words the whole sequence is one; none without words."""
    if len(words) >= n:
        return np.unique(sequence_hashes(words, n))
    return np.unique(sequence_hashes(words, len(words)) ^ np.uint64(len(words) + 1)) if len(words) else words


def text_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text; texts are hashed together in buffers of about BATCH bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= BATCH:
            yield from _together(held)
            held, size = [], 0
    yield from _together(held)


def _together(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    hashes, begins = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    yield from np.split(hashes, np.searchsorted(begins, ends[:-1]))


def column_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
