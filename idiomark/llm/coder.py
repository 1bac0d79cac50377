"""Adaptive context-mixing range coder for blocks of token ids, many blocks in lockstep.

Three orders predict each id. Orders 2 and 1 look up the context, the last two ids
or the last one, in a table of the block, and name one id each; order 0 is the
frequency of every id in the shard, a table that stands before its blocks. How
likely the named id is to be right is mixed in the logistic domain from two
adaptive estimates, that of the table's entry and that of the order's recent
success in the block; the error of the mixture teaches both. The chances of order
2, of order 1 where that is wrong, and of every other id by order 0 divide the
range of the coder, so an id costs one step.

Every block starts afresh from the shard's table, so any block decodes alone. All
arithmetic is on integers, so that every machine decodes what any other encoded.
Ids are below 65536.
"""

from __future__ import annotations

import numpy as np

SLOTS = 256
#: Bits of a probability, of a frequency, and of both together, by which the range is divided.
CHANCE, FREQUENCY = 12, 16
TOTAL = CHANCE + FREQUENCY
ONE = 1 << CHANCE
#: Least and most chance of a named id; a full estimate, in 256ths; how fast entries and orders learn.
LEAST, MOST, SURE, ENTRY_RATE, ORDER_RATE = 24, 3840, 2047, 4, 7
#: Odd numbers that spread contexts over the table.
_A, _B = np.int32(40503), np.int32(60493)
_LOW32, _32, _TOTAL = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(TOTAL)


def _squash(x: int) -> int:
    """Integer logistic function: -2047..2047 to 1..4095, by interpolation between fixed values."""
    # 4096 / (1 + exp(-x / 256)) at x = -2048, -1920, ..., 2048.
    t = (1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094)
    x = max(-2047, min(2047, x))
    w, i = x & 127, (x >> 7) + 16
    return (t[i] * (128 - w) + t[i + 1] * w + 64) >> 7


#: Chance of a named id by the sum of its two estimates, which start at -2048.
SQUASH = np.asarray([max(LEAST, min(MOST, _squash(x))) for x in range(-2048, 2048)], np.int32)


class Order0:
    """Frequencies of ids: of each id its start and width, of each of 65536 units the id that holds it."""

    def __init__(self, ids: np.ndarray | None = None, f: np.ndarray | None = None):
        """Equal frequencies of all ids without a table; one has distinct, ascending ids and frequencies of 65535 in all."""
        self.ids, self.f = ids, f
        if ids is None:
            self.width, self.start, self.holder = np.ones(1 << FREQUENCY, np.int32), np.arange(1 << FREQUENCY, dtype=np.int32), np.arange(1 << FREQUENCY, dtype=np.int32)
            return
        self.width, self.start, self.holder = np.zeros(1 << FREQUENCY, np.int32), np.zeros(1 << FREQUENCY, np.int32), np.zeros(1 << FREQUENCY, np.int32)
        self.width[ids], self.start[ids] = f, np.cumsum(f) - f
        self.holder[: int(f.sum())] = np.repeat(ids, f)

    @classmethod
    def counted(cls, n: np.ndarray) -> Order0:
        """Of how often each id occurs; every id that does has at least one unit."""
        found = np.flatnonzero(n)
        n = n[found]
        f = 1 + n * ((1 << FREQUENCY) - 1 - len(found)) // max(1, int(n.sum()))
        f[np.argmax(n)] += (1 << FREQUENCY) - 1 - f.sum()
        return cls(found, f)


class Model:
    """State of `lanes` blocks. An entry of `table` is a named id above its estimate."""

    def __init__(self, lanes: int, order0: Order0):
        self.order0 = order0
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)
        self.first = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes) * SLOTS
        self.recent = np.full((2, lanes), (2048 - 400) << ORDER_RATE, np.int32)
        self.last, self.last2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.at, self.where, self.entry = np.zeros((2, lanes), np.int64), np.zeros((2, lanes), np.int32), np.zeros((2, lanes), np.int32)
        self.chance = np.zeros((2, lanes), np.int32)

    def predict(self) -> None:
        """Names an id by each order, with its chance; an id that both name is order 2's."""
        where, one = self.where, self.last * _A
        np.add(one, self.last2 * _B, out=where[0])
        where[0] >>= 6
        np.right_shift(one, 5, out=where[1])
        where &= SLOTS - 1
        where += self.first
        self.at[...] = where
        self.table.take(self.at, out=self.entry, mode="clip")
        self.named, self.estimate = self.entry >> 11, self.entry & SURE
        SQUASH.take((self.recent >> ORDER_RATE) + self.estimate, out=self.chance, mode="clip")
        self.chance[1] *= self.named[0] != self.named[1]
        self.end2 = self.chance[0]
        self.end1 = self.end2 + (((ONE - self.end2) * self.chance[1]) >> CHANCE)

    def interval(self, ids: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of ids within 2 ** TOTAL units."""
        o, end2, end1 = self.order0, self.end2, self.end1
        rest = ONE - end1
        start, width = (end1 << FREQUENCY) + rest * o.start.take(ids, mode="clip"), rest * o.width.take(ids, mode="clip")
        np.copyto(start, end2 << FREQUENCY, where=hit[1])
        np.copyto(width, (end1 - end2) << FREQUENCY, where=hit[1])
        np.copyto(start, 0, where=hit[0])
        np.copyto(width, end2 << FREQUENCY, where=hit[0])
        return start.astype(np.uint64), width.astype(np.uint64)

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Whether order 2, or order 1 and not it, names the id."""
        hit = self.named == ids
        hit[1] &= ~hit[0]
        return hit

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        error = (hit.astype(np.int32) << CHANCE) - self.chance
        error[1] *= ~hit[0]
        self.recent += error
        self.estimate += error >> ENTRY_RATE
        np.minimum(self.estimate, SURE, out=self.estimate)
        np.copyto(self.named, ids, where=self.estimate < 0)
        np.maximum(self.estimate, 0, out=self.estimate)
        self.named <<= 11
        self.named |= self.estimate
        self.table[self.at] = self.named
        self.last2, self.last = self.last, ids


class _Encoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.out, self.at = np.zeros((lanes, room), np.uint32), np.zeros(lanes, np.int64)

    def put(self, start: np.ndarray, width: np.ndarray) -> None:
        """Narrows each lane's range to [start, start + width) units."""
        unit = self.range >> _TOTAL
        start *= unit
        self.low += start
        over = np.flatnonzero(self.low < start)
        if len(over):
            self.carry(over)
        np.multiply(unit, width, out=self.range)
        small = np.flatnonzero(self.range <= _LOW32)
        if len(small):
            low = self.low[small]
            self.out[small, self.at[small]] = low >> _32
            self.at[small] += 1
            self.low[small] = low << _32
            self.range[small] <<= _32

    def carry(self, lanes: np.ndarray) -> None:
        back = self.at[lanes] - 1
        while len(lanes):
            self.out[lanes, back] += np.uint32(1)
            more = self.out[lanes, back] == 0
            lanes, back = lanes[more], back[more] - 1

    def finish(self) -> list[np.ndarray]:
        every = np.arange(len(self.low))
        for part in (self.low >> _32, self.low & _LOW32):
            self.out[every, self.at] = part
            self.at += 1
        return [self.out[i, :n] for i, n in enumerate(self.at)]


class _Decoder:
    def __init__(self, payloads: list[np.ndarray]):
        lanes = len(payloads)
        self.words = np.zeros((lanes, max(len(p) for p in payloads) + 2), np.uint64)
        for i, p in enumerate(payloads):
            self.words[i, : len(p)] = p
        self.code = (self.words[:, 0] << _32) | self.words[:, 1]
        self.at, self.range = np.full(lanes, 2, np.int64), np.full(lanes, 2**64 - 1, np.uint64)
        self.end = self.words.shape[1] - 1

    def value(self) -> np.ndarray:
        """The unit that the code lies in, of 2 ** TOTAL."""
        self.unit = self.range >> _TOTAL
        return np.minimum(self.code // self.unit, np.uint64((1 << TOTAL) - 1)).astype(np.int32)

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        start *= self.unit
        self.code -= start
        np.multiply(self.unit, width, out=self.range)
        small = np.flatnonzero(self.range <= _LOW32)
        if len(small):
            at = self.at[small]
            self.code[small] = (self.code[small] << _32) | self.words[small, np.minimum(at, self.end)]
            self.at[small] = at + 1
            self.range[small] <<= _32


def encode(blocks: np.ndarray, order0: Order0 | None = None) -> list[np.ndarray]:
    """Payloads (32-bit words) of blocks (lanes, length) of ids."""
    lanes, length = blocks.shape
    m, rc = Model(lanes, order0 or Order0()), _Encoder(lanes, length + 8)
    columns = np.ascontiguousarray(blocks.T.astype(np.int32))
    for ids in columns:
        m.predict()
        hit = m.hits(ids)
        rc.put(*m.interval(ids, hit))
        m.update(ids, hit)
    return rc.finish()


def decode(payloads: list[np.ndarray], length: int, order0: Order0 | None = None) -> np.ndarray:
    """The blocks (lanes, length) of payloads."""
    lanes = len(payloads)
    m, rc = Model(lanes, order0 or Order0()), _Decoder(payloads)
    out = np.empty((length, lanes), np.uint32)
    for t in range(length):
        m.predict()
        value = rc.value()
        rest, chance = value - (m.end1 << FREQUENCY), value >> FREQUENCY
        unit = (np.maximum(rest, 0) / (ONE - m.end1)).astype(np.int64)  # exact: both are far below 2 ** 53
        ids = m.order0.holder.take(unit, mode="clip")
        np.copyto(ids, m.named[1], where=chance < m.end1)
        np.copyto(ids, m.named[0], where=chance < m.end2)
        hit = m.hits(ids)
        rc.take(*m.interval(ids, hit))
        m.update(ids, hit)
        out[t] = ids
    return out.T
