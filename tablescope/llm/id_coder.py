"""Blocks of token ids, compressed by a context-mixing model and a range coder; each block decodes on its own and is checked.

A block's ids are cut into lanes of STEPS ids that are coded side by side, so every step of the model works on all lanes at once.  The
lanes of a block share one adaptive model: counts of all ids so far (order 0), the id last seen after the one before (order 1) and after
the two before (order 2).  The three are mixed by how often predictions of that confidence have held in the block.  Order 0 is counted
anew whenever the block has grown by a quarter, the mixture follows every fourth step after the first sixteen, the guesses every step.

A distribution divides 2^(bits + 10): each guess takes some 1024ths of it and order 0 divides the rest into 2^bits slots, of which every
id of the block has one or more.  The words of all lanes are one series, in the order in which the decoder takes them.

More than MOST ids are a sealed series of blocks.  The limit bounds the memory of a block and keeps a distribution within 32 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDB2"
SERIES = b"IDS1"
SERIES_HEAD = "<4sQI"
HEAD = "<4sQIIIII"
STEPS = 256
MOST = 3 << 19
SHARES = 10  # bits of the mixture
SLOTS_BITS = 18
LEVELS = 8
DENSE = 1 << 20
_U = np.uint64
_HALF, _WORD = _U(32), _U(1 << 32)
# what a guess and its trust become, by 2 * trust + (1 if it held): added to 8 * guess + trust
_DRIFT = np.array([step for sure in range(LEVELS) for step in (-((sure + 1) >> 1), int(sure < LEVELS - 1))], np.int32)


class _Mixer:
    """The model of one block; coder and decoder make the same steps."""

    def __init__(self, symbols: int, lanes: int, find: bool = False):
        self.bits = min(32 - SHARES, symbols.bit_length() + 4)
        self.total = _U(self.bits + SHARES)
        self.count, self.seen, self.find_ids = np.zeros(symbols, np.int64), 0, find
        self.before = np.zeros(lanes, np.int64)
        self.slot = np.zeros(lanes, np.int64)
        self.mixed = np.zeros(lanes, np.uint32)
        self.table = [np.zeros(symbols, np.int32), np.zeros(1 << SLOTS_BITS, np.int32)]  # 8 * guess + trust
        self.held = [np.ones(LEVELS), np.ones(LEVELS)]
        self.tried = [np.full(LEVELS, 8.0), np.full(LEVELS, 8.0)]
        self.fresh, self.steps, self.due = [], 0, 1
        self._sum()

    def _sum(self) -> None:
        symbols = len(self.count)
        spare = (1 << self.bits) - symbols
        upto = np.cumsum(self.count) * spare // self.seen if self.seen else np.arange(1, symbols + 1) * spare // symbols
        self.cum = np.concatenate([np.zeros(1, np.int64), upto + np.arange(1, symbols + 1)]).astype(np.uint32)
        self.width = np.diff(self.cum)
        if self.find_ids:
            self.owner = np.repeat(np.arange(symbols, dtype=np.int32), self.width)

    def predict(self, lanes: int) -> None:
        """Guesses of order 1 and 2 for the first ``lanes`` lanes, their masses, and what a slot of order 0 weighs."""
        self.at = (self.before[:lanes], self.slot[:lanes])
        entries = [t.take(a) for t, a in zip(self.table, self.at)]
        self.entries, self.said, self.sure = entries, [e >> 3 for e in entries], [e & 7 for e in entries]
        if self.steps < 16 or not self.steps % 4:
            self._share()
        both = ((self.sure[1] << 3) + self.sure[0]).astype(np.intp)
        self.mass = [x.take(both) for x in self.masses]
        self.weight = self.weights.take(both)

    def _share(self) -> None:
        """What the guesses of each pair of trusts get, and order 0 beside them."""
        share = [np.minimum(h / t * (1 << SHARES), 0.875 * (1 << SHARES)).astype(np.int64) for h, t in zip(self.held, self.tried)]
        two = np.repeat(share[1], LEVELS)
        one = ((1 << SHARES) - two) * np.tile(share[0], LEVELS) >> SHARES
        self.masses = [(x << self.bits).astype(np.uint32) for x in (one, two)]
        self.weights = ((1 << SHARES) - one - two).astype(np.uint32)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.cum.take(ids) * self.weight, self.width.take(ids) * self.weight
        self.ids = ids.astype(np.int32)
        self.hit = [said == self.ids for said in self.said]
        for said, hit, mass in zip(self.said, self.hit, self.mass):
            start += mass * (said < self.ids)
            size += mass * hit
        return start.astype(_U), size.astype(_U)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds the value.  A guess's mass lies behind its slots and is taken out, the smaller guess first."""
        swap = self.said[0] > self.said[1]
        first, last = np.minimum(*self.said), np.maximum(*self.said)
        for said, mass in ((first, np.where(swap, *self.mass[::-1])), (last, np.where(swap, *self.mass))):
            slots = self.cum.take(said + 1) * self.weight - np.uint32(1)
            value = value - np.minimum(value - np.minimum(value, slots), mass)
        return self.owner.take((value / self.weight).astype(np.int64)).astype(np.int64)  # exact: both are below 2^32

    def update(self, ids: np.ndarray) -> None:
        """``ids`` are those that ``interval`` was last asked for."""
        first, codes = self.ids << 3, [(sure << 1) + hit for sure, hit in zip(self.sure, self.hit)]
        if self.steps < 16 or self.steps % 4 == 3:
            tally = np.bincount((codes[0] << 4) + codes[1], minlength=4 * LEVELS * LEVELS).reshape(2 * LEVELS, 2 * LEVELS)
            for k in range(2):
                each = tally.sum(1 - k)
                self.held[k] += each[1::2]
                self.tried[k] += each[::2] + each[1::2]
        for k in range(2):
            self.table[k][self.at[k]] = np.where(codes[k] == 0, first, self.entries[k] + _DRIFT.take(codes[k]))
        lanes = len(ids)
        now = self.ids.view(np.uint32)
        self.slot[:lanes] = (self.mixed[:lanes] + now * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOTS_BITS)
        self.mixed[:lanes] = now * np.uint32(0x9E3779B1)
        self.before[:lanes] = ids
        self.fresh.append(ids)
        self.steps += 1
        if self.steps >= self.due:
            new = np.concatenate(self.fresh)
            self.count += np.bincount(new, minlength=len(self.count))
            self.seen, self.fresh, self.due = self.seen + len(new), [], self.steps + max(1, self.steps // 4)
            self._sum()


def _shape(n: int) -> tuple[int, int]:
    """Number of lanes, and ids of the last."""
    lanes = -(-n // STEPS)
    return lanes, n - (lanes - 1) * STEPS


def encode(ids: np.ndarray) -> bytes:
    """Any number of unsigned 32-bit ids as one block, or as a series of blocks; the same ids give the same bytes."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) <= MOST:
        return _block(ids)
    blocks = [_block(part) for part in np.array_split(ids, -(-len(ids) // MOST))]
    sizes = np.array([len(b) for b in blocks], dtype="<u8").tobytes()
    return _sealed(b"".join([struct.pack(SERIES_HEAD, SERIES, len(ids), len(blocks)), sizes, *blocks]))


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and the place of each id among them."""
    if not len(ids) or ids.max() >= DENSE:
        return np.unique(ids, return_inverse=True)
    there = np.bincount(ids) > 0
    return np.flatnonzero(there).astype("<u4"), (np.cumsum(there) - 1).take(ids)


def _block(ids: np.ndarray) -> bytes:
    alphabet, dense = _dense(ids)
    symbols = zlib.compress(np.diff(alphabet, prepend=np.uint32(0)).astype("<u4").tobytes(), 6)
    if not len(ids):
        return _sealed(struct.pack(HEAD, MAGIC, 0, 0, zlib.crc32(b""), 0, len(symbols), 0) + symbols)
    lanes, last = _shape(len(ids))
    flat = np.zeros(lanes * STEPS, np.int64)
    flat[:len(ids)] = dense
    matrix = np.ascontiguousarray(flat.reshape(lanes, STEPS).T)
    model = _Mixer(len(alphabet), lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, _U(2**64 - 1))
    out, place, taken = np.zeros((STEPS + 2) * lanes, np.uint32), np.arange(lanes), [np.arange(2 * lanes)]
    for step in range(min(STEPS, len(ids))):
        active = lanes if step < last else lanes - 1
        if not active:
            break
        model.predict(active)
        start, size = model.interval(matrix[step, :active])
        unit = width[:active] >> model.total
        moved = unit * start
        low[:active] += moved
        _carry(out, place[np.flatnonzero(low[:active] < moved)], lanes)
        width[:active] = unit * size
        model.update(matrix[step, :active])
        at = np.flatnonzero(width[:active] < _WORD)
        to = place[at]
        out[to] = low[at] >> _HALF
        low[at] <<= _HALF
        width[at] <<= _HALF
        place[at] = to + lanes
        taken.append(to + 2 * lanes)
    for _ in range(2):
        out[place] = low >> _HALF
        low <<= _HALF
        place += lanes
    words = out[np.concatenate(taken)].astype("<u4").tobytes()
    head = struct.pack(HEAD, MAGIC, len(ids), STEPS, zlib.crc32(ids.tobytes()), len(alphabet), len(symbols), len(words))
    return _sealed(head + symbols + words)


def _carry(out: np.ndarray, place: np.ndarray, lanes: int) -> None:
    """Add one to the words before these places, and to those before them where a word passes its end."""
    while len(place):
        place = place - lanes
        out[place] += np.uint32(1)
        place = place[out[place] == 0]


def _sealed(block: bytes) -> bytes:
    return block + struct.pack("<I", zlib.crc32(block))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block or a series of blocks; raises ValueError if it is damaged."""
    if len(block) < struct.calcsize(SERIES_HEAD) + 4 or _sealed(block[:-4]) != block:
        raise ValueError("damaged block of ids")
    if block[:4] != SERIES:
        return _decoded_block(block[:-4])
    _, n, parts = struct.unpack_from(SERIES_HEAD, block)
    at = struct.calcsize(SERIES_HEAD)
    ends = at + 8 * parts + np.cumsum(np.frombuffer(block, "<u8", parts, at), dtype=np.int64)
    begins = [at + 8 * parts, *ends[:-1].tolist()]
    result = np.concatenate([decode(block[a:b]) for a, b in zip(begins, ends.tolist())])
    if len(result) != n:
        raise ValueError("damaged block of ids")
    return result


def _decoded_block(block: bytes) -> np.ndarray:
    if len(block) < struct.calcsize(HEAD):
        raise ValueError("damaged block of ids")
    magic, n, steps, crc, symbols, n_symbols, n_words = struct.unpack_from(HEAD, block)
    if magic != MAGIC or len(block) != struct.calcsize(HEAD) + n_symbols + n_words or (n and steps != STEPS):
        raise ValueError("not a block of ids")
    at = struct.calcsize(HEAD)
    try:
        alphabet = np.cumsum(np.frombuffer(zlib.decompress(block[at:at + n_symbols]), "<u4"), dtype=np.uint32)
        ids = _decoded(block, at + n_symbols, n, symbols) if n else np.zeros(0, np.int64)
        result = alphabet[ids].astype("<u4") if n else np.zeros(0, "<u4")
    except (zlib.error, IndexError, ValueError) as error:
        raise ValueError("damaged block of ids") from error
    if zlib.crc32(result.tobytes()) != crc:
        raise ValueError("damaged block of ids")
    return result


def _decoded(block: bytes, at: int, n: int, symbols: int) -> np.ndarray:
    lanes, last = _shape(n)
    words = np.frombuffer(block, "<u4", offset=at).astype(_U)
    code, place = (words[:lanes] << _HALF) | words[lanes:2 * lanes], 2 * lanes
    model = _Mixer(symbols, lanes, find=True)
    width = np.full(lanes, _U(2**64 - 1))
    most = (_U(1) << model.total) - _U(1)
    matrix = np.zeros((STEPS, lanes), np.int64)
    for step in range(min(STEPS, n)):
        active = lanes if step < last else lanes - 1
        if not active:
            break
        model.predict(active)
        unit = width[:active] >> model.total
        ids = model.find(np.minimum(code[:active] // unit, most).astype(np.uint32))
        start, size = model.interval(ids)
        matrix[step, :active] = ids
        code[:active] -= unit * start
        width[:active] = unit * size
        model.update(ids)
        to = np.flatnonzero(width[:active] < _WORD)
        code[to] = (code[to] << _HALF) | words[place:place + len(to)]
        width[to] <<= _HALF
        place += len(to)
    return matrix.T.reshape(-1)[:n]
