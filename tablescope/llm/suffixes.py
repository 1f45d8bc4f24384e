"""Suffix arrays of byte strings and the anchors by which equal passages are found again, in numpy.

``suffix_array`` refines groups of equal prefixes, doubling the compared length and sorting only groups that are not settled yet (Larsson
and Sadakane).  ``common_prefixes`` is Kasai's scan, run in many lanes at once, each lane a stretch of the string.  Nothing here knows of
Spark."""

from __future__ import annotations

import numpy as np

from .texts import mix

PAD = 255
_LANES = 4096
_PLACE = np.uint64((1 << 24) - 1)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _UNBASE: np.ones(1, np.uint64)}


def _powers_to(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(base))]))
    return _powers[base]


class RangeHashes:
    """64-bit hashes of any ranges of a byte string: equal bytes have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _powers_to(_BASE, len(data) + 1)[:len(data)])])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        at_zero = (self.sums[ends] - self.sums[starts]) * _powers_to(_UNBASE, len(self.sums) + 1)[starts]
        return mix(at_zero + np.uint64(seed) * (ends - starts).astype(np.uint64) + np.uint64(seed))


def _least(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours, by doubling."""
    span = 1
    while 2 * span <= n:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[:len(keys) - n + span], keys[n - span:]) if n > span else keys


def anchored_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, start, number of windows, anchor hash, hash of all bytes) of every run of windows that share an anchor.

    ``data`` holds texts at ``begins`` to ``ends``, at most 2^24 bytes in all.  A window is ``width`` bytes of one text, its anchor the
    first of its k-byte strings with the least hash.  Equal windows have equal anchors, so they are in runs of one anchor hash, and each window is in one run."""
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ranges = RangeHashes(data)
    place = np.arange(len(data) - k + 1)
    grams = ranges(place, place + k, 1)
    chosen = (_least((grams & ~_PLACE) | place.astype(np.uint64), width - k + 1) & _PLACE).astype(np.int64)
    counts = np.maximum(ends - begins - width + 1, 0)
    text = np.repeat(np.arange(len(begins)), counts)
    if not len(text):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    window = np.arange(len(text)) + np.repeat(begins - np.cumsum(counts) + counts, counts)
    anchor = chosen[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.append(first, len(window)))
    start = window[first]
    return text[first], start - begins[text[first]], n, grams[anchor[first]], ranges(start, start + n + width - 1, 3)


def _eight(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from every place on as one number; PAD beyond the end."""
    padded = np.concatenate([data, np.full(8, PAD, np.uint8)])
    return np.ndarray((len(data),), kind, padded, strides=(1,))


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the suffixes in lexicographic order, and the number of every place in that order.

    Bytes beyond the end compare as PAD, then the earlier end is the larger."""
    n = len(data)
    keys = _eight(data, ">u8").astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    rank = np.empty(n, np.int64)
    at, length = np.arange(n), 8
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        rank[order[at]] = np.repeat(at[begin], np.diff(np.append(begin, len(at))))
        alone = new & np.append(new[1:], True) if len(new) else new
        at = at[~alone]
        if not len(at):
            return order, rank
        place = order[at]
        after = place + length
        beyond = after >= n  # of two such suffixes in a group the later one is the shorter
        follow = np.where(beyond, n + n - place, rank[np.minimum(after, n - 1)]).astype(np.uint64)
        keys = (rank[place].astype(np.uint64) << np.uint64(32)) | follow
        turn = np.argsort(keys)
        order[at], keys = place[turn], keys[turn]
        length *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = _LANES) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in order, ``most`` at most; 0 for the first one."""
    n = len(data)
    padded = np.concatenate([data, np.full(most + 16, PAD, np.uint8)])
    eight = np.ndarray((n + most + 8,), "<u8", padded, strides=(1,))
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    if n:
        before[order[0]] = -1
    stretch = -(-n // lanes) if n else 0
    found = np.zeros(n, np.int64)
    shared = np.zeros(lanes, np.int64)
    begin = np.arange(lanes) * stretch
    for step in range(stretch):
        here = begin + step
        live = np.flatnonzero(here < np.minimum(begin + stretch, n))
        here = here[live]
        prior = before[here]
        length = np.maximum(shared[live] - 1, 0)
        length[prior < 0] = 0
        open_ = np.flatnonzero((prior >= 0) & (length < most))
        while len(open_):
            differ = eight[here[open_] + length[open_]] ^ eight[prior[open_] + length[open_]]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            length[open_] += same
            open_ = open_[(same == 8) & (length[open_] < most)]
        shared[live] = length
        found[here] = np.minimum(length, most)
    return found[order]
